"""Sizes as text equal their SQL, ties and near-ties included."""

import duckdb

from oxbow.plans import catalog

catalog.load()


def test_sizes_near_a_tie_equal_their_sql(spark, tmp_path):
    # o_orderkey 0 leaves o_totalprice as it is: the sizes themselves
    sizes = [119239030000.0, 1280.0, 1281.0, 1374390375513.0, 1374389534720.0, 1407374883553281.0, 1407374883553280.0, 1023.0, 1024.0, -5.0, 9e15]
    rows = [(9 * k, n) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["format_bytes"](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(catalog.ORACLES["format_bytes"]).fetchall())
    assert {n: shown for _, n, shown in got}[119239030000] == "111.1 GiB"
