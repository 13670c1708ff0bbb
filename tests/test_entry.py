"""The driver's entry points, with and without the separable parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_it_imports_without_the_corpus_parts(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "oxbow"), tmp_path / "oxbow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if with_pipeline:
        if not os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            pytest.skip("the pipeline is not here")
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
