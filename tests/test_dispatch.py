"""Dispatches that heed part ends, against SQL and the rule itself."""

import random

import duckdb
from pyspark.sql import functions as F

from oxbow.operators import planning
from oxbow.plans import catalog

catalog.load()


def test_dispatches_of_odd_documents_equal_their_sql(spark, tmp_path):
    rng = random.Random(3)
    sizes = [0, 1, 4095, 4096, 4097, 8192, 20000, 30000, 50]
    rows = [(k, f"s{k % 4}", "é" * (n // 2) + "x" * (n % 2)) for k, n in enumerate(rng.choices(sizes, k=120))]
    rows += [(k, "s1", None) for k in (-1, 500)] + [(k, None, "y" * 9000) for k in (600, 601, 602)] + [(700, "void", ""), (701, "none", None), (702, "whole", "z" * 90000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["dispatch_within_parts"](spark, str(tmp_path)).collect()]
    want = c.sql(catalog.ORACLES["dispatch_within_parts"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def _plainly(chunks, ends, target, chunk):
    out, cap = [], None
    for k in sorted(chunks):
        if out and k == sum(out[-1]) and out[-1][1] < target and cap is not None and k * chunk < cap:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((k, 1))
            cap = min((e for e in ends if e >= (k + 1) * chunk), default=max(ends, default=None))
    return out


def test_dispatches_follow_the_rule_and_no_row_carries_all_ends(spark):
    rng = random.Random(4)
    opened = {s: sorted(rng.sample(range(60), 45)) for s in range(12)}
    ends = {s: sorted(rng.randrange(1, 520) for _ in range(rng.randrange(0, 30))) for s in range(12)}
    ends[3], ends[5] = [], [8, 16, 16, 24]
    states = spark.createDataFrame([(s, k, k not in opened[s]) for s in opened for k in range(60)], "source_id long, chunk_idx long, complete boolean")
    bounds = spark.createDataFrame([(s, e) for s in ends for e in ends[s]], "source_id long, end_off long")
    got = planning.coalesce_within_parts(states, bounds, 4, 8)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((s, *d) for s in opened for d in _plainly(opened[s], ends[s], 4, 8))


def test_ends_and_chunks_of_a_source_meet_however_partitions_are_merged(spark):
    """The parts' exchange is far larger than the totals', so the two are merged to unlike numbers of partitions."""
    conf = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        parts = spark.range(4000).selectExpr("concat('s', id % 20) AS source_id", "id AS part_idx", "cast(90 AS long) AS size")
        totals = parts.groupBy("source_id").agg(F.sum("size").alias("total_size"))
        states = planning.chunks(totals, 8).selectExpr("source_id", "chunk_idx", "chunk_idx % 7 = 2 AS complete")
        got = planning.coalesce_within_parts(states, planning.part_bounds(parts), 4, 8)
        each = _plainly([k for k in range(2250) if k % 7 != 2], [90 * (k + 1) for k in range(200)], 4, 8)
        assert sorted(map(tuple, got.collect())) == sorted((f"s{s}", *d) for s in range(20) for d in each)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
