"""Two-pass external shuffle into shards.  DataFrame functions only.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash; pass two shuffles each bucket (``shuffle`` is Spark's Fisher-Yates
over an array), deals the concatenated buckets to the shards in turn and writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import stage, stage_path

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: A record counts as this many bytes at least, so that a bucket of empty texts is bounded too.
RECORD_BYTES = 256
#: Buckets whose places are summed together before the groups' are.
GROUP = 4096


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 20240117,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: tuple[str, ...] = (),
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, the ``payload`` columns (as a
    struct ``record`` where asked for), bucket, shard, slot.

    Law ``rows``: shard counts differ by one at most; slots run from 0 without gaps.
    Null text: size 1, checksum 0.  Null or repeated ids and repeated rows: every
    row gets a place of its own, as the scatter hash also takes the row's place in
    the input, so that no key can fill a bucket (so another split of the input's files
    gives another order).  A very long text makes its bucket longer.  Empty table: no
    rows.  Only the named columns are read, whatever others are called.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *([F.struct(*[F.col(c) for c in payload]).alias("record")] if payload else []),
    ).withColumn("u", F.xxhash64(F.lit(seed), "place", "doc_id", "text_crc32")).drop("place")
    rows = stage(rows, "shard-scatter")
    total = rows.agg(F.sum(F.greatest(F.col("size"), F.lit(RECORD_BYTES))).alias("b")).first()["b"] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("u", F.lit(n_buckets)))
    # Where each bucket begins: sums within groups of buckets, and over the groups.
    counts = rows.groupBy("bucket").count().withColumn("group", F.floor(F.col("bucket") / GROUP))
    within = counts.select("bucket", "group", F.expr("sum(count) over (partition by group order by bucket) - count").alias("at"))
    groups = counts.groupBy("group").agg(F.sum("count").alias("count")).select("group", F.expr("sum(count) over (order by group) - count").alias("base"))
    starts = within.join(groups, "group").select("bucket", (F.col("at") + F.col("base")).alias("start"))
    held = [c for c in rows.columns if c not in ("bucket",)]
    dealt = (
        rows.groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("u", *[c for c in held if c != "u"]))).alias("rows"))
        .join(starts, "bucket")
        .sortWithinPartitions("bucket")  # a task's seeded draws then come in one order
        .select("bucket", "start", F.shuffle("rows", seed).alias("rows"))
        .select("bucket", "start", F.posexplode("rows").alias("pos", "row"))
    )
    place = F.col("start") + F.col("pos")
    return dealt.select(
        "row.doc_id", "row.size", "row.text_crc32",
        *(["row.record"] if payload else []),
        "bucket",
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"(start + pos) div {n_shards}").cast("long").alias("slot"),
    )


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **options) -> tuple[str, str]:
    """Shuffle whole records and write one folder per shard; returns the names of the
    shard and slot columns (``_shard`` and ``_slot``, longer where ``docs`` has such).

    Each task writes the shards' parts of its buckets, in slot order, so no record is
    moved a third time; slots order the files' rows over all tasks.
    """
    shard, slot = (_unused(c, docs.columns) for c in ("_shard", "_slot"))
    out = shuffle_into_shards(docs, n_shards, payload=tuple(docs.columns), **options)
    out.select("record.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return shard, slot


def sharded(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, all taken from the shards as written to the
    shared folder and read back."""
    spark = docs.sparkSession
    path = stage_path(spark, "shards")
    shard, slot = write_shards(docs, path, n_shards, id_col=id_col, text_col=text_col, **options)
    # An empty table has no folder of a shard, so the schema is told.
    back = spark.read.schema(docs.withColumn(slot, F.lit(0).cast("long")).withColumn(shard, F.lit(0)).schema).parquet(path)
    text = F.coalesce(back[text_col], F.lit(""))
    return back.select(
        back[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        back[shard].cast("int").alias("shard"), back[slot].cast("long").alias("slot"),
    )
