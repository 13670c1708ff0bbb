"""The folder source finds, decodes and lists archives of every kind."""

import gzip

from oxbow.sources import packers
from oxbow.sources.archive_source import read_archives


def test_folder_of_archives(spark, tmp_path):
    entries = [("a.txt", b"one"), ("b.txt", b"two")]
    for name, pack in packers.PACKERS.items():
        (tmp_path / f"x.{name}").write_bytes(pack(entries))
    (tmp_path / "y.tar.gz").write_bytes(gzip.compress(packers.pack_tar(entries)))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04junk")
    (tmp_path / "note.txt").write_bytes(b"plain")
    rows = read_archives(spark, f"file://{tmp_path}").collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 10 and {bytes(r["content"]) for r in good} == {b"one", b"two"}
    assert sorted(r["error"] for r in rows if r["error"]) == ["no decoder", "no end of central directory"]
