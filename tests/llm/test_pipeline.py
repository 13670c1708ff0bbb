"""run() against the stages' brute-force versions, one after the other."""

import hashlib
import random

import pytest
from test_operators import BPE, components_by_force, prose, shingle_set, spread_by_force

import corpus_pipeline
from oxbow.llm import linespread


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    rng = random.Random(11)
    lines = [prose(rng, 6) for _ in range(3)]
    items = [(k, prose(rng, 20)) for k in range(4)]
    rows = []
    for k in range(160):
        body = [prose(rng, 12) for _ in range(4)]
        if k % 3 == 0:
            body.insert(k % 4, lines[k % 2])
        if k % 20 == 7:
            body.append(f"as said: {items[k % 4][1]} and so on")
        rows.append([k, "\n".join(body), "en", f"src{k % 20}", 0])
    for k in range(160, 200):  # copies and near copies
        text = rows[k - 150][1]
        rows.append([k, text if k % 2 else text.replace(" ", "  ", 1) + " end", "en", f"src{k % 20}", 0])
    rows += [[200, None, "en", "src1", 0], [201, "12 345 --", "en", "src1", 9], [202, "", None, None, 0]]
    path = tmp_path_factory.mktemp("sf")
    docs_of(rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


class Doc(dict):
    pass


def test_run_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path, rows, items = folder
    docs = [Doc(doc_id=r[0], text=r[1], source=r[3]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    cut = {r[0]: r[1] for r in spread_by_force(docs, linespread.MIN_SITES, linespread.MIN_CHARS)}
    docs = [Doc(doc_id=d["doc_id"], text=cut[d["doc_id"]]) for d in docs]
    groups = components_by_force(docs)
    docs = [d for d in docs if groups[d["doc_id"]][1] == d["doc_id"]]
    sets = [shingle_set(t) for _, t in items]
    docs = [d for d in docs if not any(len(q & shingle_set(d["text"])) >= 0.75 * len(q) for q in sets)]
    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    want = []
    for d in docs:
        ids = t.encode(d["text"], add_special_tokens=False).ids
        want.append((d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert 100 < len(want) < 165


def test_stages_but_the_last_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, path).columns == docs.columns
