"""Rates of every unit, kinds of failure, and archives that share a tree."""

from pathlib import Path

from pyspark.sql import functions as F

from oxbow.functions.hashing import crc32c
from oxbow.operators import analytics as A
from oxbow.plans import catalog
from oxbow.sources.sinks import write_tree

catalog.load()


def test_rates_of_all_units_are_shown(spark, tmp_path):
    rows = [(4, 5.0), (1, 0.1), (2, 0.010486), (3, 0.5), (5, None), (9, 5e8)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["shown"] for r in catalog.QUERIES["format_rate"](spark, str(tmp_path)).collect()}
    assert got == {4: "500 B/s", 1: "9.8 KiB/s", 2: "1.0 MiB/s", 3: "46.6 GiB/s", 5: "—", 9: "—"}


def test_sizes_grow_shrink_and_hold(spark):
    took = {1: 100, 2: 100, 3: 6_000_000, 4: 100, 5: 100, 6: 6_000_000}  # microseconds of each sample
    samples = [(k, 50_000_000 + i, i, us, False) for k, us in took.items() for i in range(8 if k != 5 else 7)]
    samples += [(1, 10, 99, 9_000_000, True)] * 20  # from before the last change
    state = [(1, 400, 20, 4, 40, 90_000_000), (2, 400, 7, 4, 40, 90_000_000), (3, 500, 20, 4, 40, 90_000_000)]
    state += [(4, 400, 20, 4, 49_000_000, 70_000_000), (5, 400, 20, 4, 40, 90_000_000), (6, 200, 20, 4, 40, 90_000_000)]
    got = A.resize_decisions(
        spark.createDataFrame(samples, "key long, at_us long, seq long, elapsed_us long, retried boolean"),
        spark.createDataFrame(state, "key long, current long, remaining long, workers long, changed_us long, now_us long"), 200, 750, 100,
    )
    assert {r["key"]: (r["decision"], r["size"]) for r in got.collect()} == {
        1: ("grow", 700), 2: ("hold", 400), 3: ("shrink", 300), 4: ("hold", 400), 5: ("hold", 400), 6: ("hold", 200),
    }


def test_the_only_mirror_is_never_left_out(spark):
    events = spark.createDataFrame([(1, 7, 100, 1, False), (2, 8, 100, 2, False), (2, 8, 200, 3, True)], "source long, mirror long, at_us long, seq long, ok boolean")
    mirrors = spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "source long, mirror long")
    got = A.mirror_exclusions(events, mirrors, 1000).collect()
    assert sorted((r["seq"], r["excluded_until"]) for r in got) == [(1, None), (2, 1100), (3, 1100)]


def test_only_passing_failures_are_tried_again(spark):
    rows = [("transport", None, "io"), ("transport", None, "url"), ("transport", None, None), ("status", 503, None), ("status", 404, None), ("body", None, None), ("drift", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "kind string, status int, cause string")
    assert [r[0] for r in df.select(A.retryable(F.col("kind"), F.col("status"), F.col("cause"))).collect()] == [True, False, False, True, False, True, False, False]


def test_chunk_sums_cover_bytes(spark, tmp_path):
    text = "é" * 600  # 1200 bytes: a character lies across the chunks' border at an even place only
    spark.createDataFrame([(1, "x" + text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["chunk_fingerprints"](spark, str(tmp_path)).collect())
    raw = ("x" + text).encode()
    assert got == [(1, 0, crc32c(raw[:1024])), (1, 1, crc32c(raw[1024:]))]
    assert crc32c(b"123456789") == 0xE3069283


def test_archives_share_a_tree_in_order_or_have_folders(spark, tmp_path):
    rows = [("b", 0, "x", "file", b"of b", None), ("a", 9, "x", "file", b"of a", None), ("a", 1, "y", "file", b"old", None), ("a", 2, "y", "file", b"new", None)]
    entries = spark.createDataFrame(rows, "source_id string, entry_idx long, path string, type string, content binary, crc32 long")
    read = lambda root: {str(f.relative_to(root)): f.read_bytes() for f in Path(root).rglob("*") if f.is_file() and f.name != "_SUCCESS"}
    write_tree(entries, str(tmp_path / "one"))
    assert read(tmp_path / "one") == {"x": b"of b", "y": b"new"}
    write_tree(entries, str(tmp_path / "each"), by_source=True)
    assert read(tmp_path / "each") == {"b/x": b"of b", "a/x": b"of a", "a/y": b"new"}
