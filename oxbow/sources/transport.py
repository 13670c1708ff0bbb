"""Discovery of sources from the answers of servers: sizes, mirrors, volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.functions.urls import content_range


def discover(responses: DataFrame) -> DataFrame:
    """What is known of each URL from ``responses`` (url, method, status, length, accept_ranges,
    content_range, etag, last_modified): a HEAD with a length, else the range probe's total,
    else a whole GET of unknown size.

    One row per URL: url, total_size, size_known, accept_ranges, etag, last_modified, error.
    """
    def of(method: str, field) -> F.Column:
        return F.max(F.when(F.col("method") == method, field))

    total = content_range(F.col("content_range"))["total"]
    g = responses.groupBy("url").agg(
        of("HEAD", F.col("status")).alias("head"), of("HEAD", F.col("length")).alias("length"), of("HEAD", F.col("accept_ranges").cast("int")).alias("ranges"),
        of("PROBE", F.col("status")).alias("probe"), of("PROBE", total).alias("total"), F.max("etag").alias("etag"), F.max("last_modified").alias("last_modified"),
    )
    by_head = (F.col("head").between(200, 299)) & (F.col("length") > 0)
    by_probe = F.col("probe") == 206
    size = F.when(by_head, F.col("length")).when(by_probe, F.col("total"))
    failed = ~F.coalesce(F.col("head").between(200, 299), F.lit(False)) & ~F.coalesce(F.col("probe").between(200, 299), F.lit(False))
    return g.select(
        "url", F.coalesce(size, F.lit(0)).cast("long").alias("total_size"), size.isNotNull().alias("size_known"),
        F.coalesce(F.when(by_head, F.col("ranges") == 1).when(by_probe, F.lit(True)), F.lit(False)).alias("accept_ranges"), "etag", "last_modified",
        F.when(failed, "unreachable").alias("error"),
    )


def discover_parts(parts: DataFrame) -> DataFrame:
    """A source of many parts: sizes add up, ranges hold only if all parts take them."""
    return parts.groupBy("source_id").agg(
        F.sum("total_size").alias("total_size"), F.every(F.col("size_known")).alias("size_known"), F.every(F.col("accept_ranges")).alias("accept_ranges"), F.count("*").alias("n_parts")
    )


def manifest_lines(text: DataFrame) -> DataFrame:
    """URLs of manifest files (column value): trimmed lines that are not blank or comments."""
    line = F.trim(F.col("value"))
    return text.select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def classify(source):
    """http for an http or https address, else local."""
    return F.when(source.rlike("^https?://[^/?#]+"), "http").otherwise("local")
