"""May an interrupted run go on?  Prior and present sources compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resume_verdict(prior: str = "p", now: str = "n") -> Column:
    """The first reason, in order, why a run cannot resume; null if it can."""

    def differ(c: str) -> Column:
        return ~F.col(f"{prior}.{c}").eqNullSafe(F.col(f"{now}.{c}"))

    strong = F.col(f"{prior}.etag").isNotNull() & ~F.col(f"{prior}.etag").rlike("^[Ww]/")
    return (
        F.when(F.col(f"{now}.source_id").isNull(), "gone")
        .when(F.col(f"{prior}.source_id").isNull(), "new")
        .when(differ("mode"), "mode")
        .when(differ("url"), "url")
        .when(differ("total_size"), "total size")
        .when(differ("n_parts"), "part count")
        .when(differ("chunk_size"), "chunk size")
        .when((strong & differ("etag")) | (F.col(f"{prior}.last_modified").isNotNull() & differ("last_modified")), "fingerprint")
        .when(differ("sink"), "sink")
    )


def resume_plan(prior: DataFrame, now: DataFrame) -> DataFrame:
    """source_id and verdict for every source that either side knows."""
    both = prior.alias("p").join(now.alias("n"), F.col("p.source_id") == F.col("n.source_id"), "full_outer")
    return both.select(F.coalesce("p.source_id", "n.source_id").alias("source_id"), resume_verdict().alias("verdict"))


def drifted_chunks(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (source_id, chunk_idx) whose fresh fingerprint differs from the one kept; unset ones pass."""
    both = kept.where("fingerprint is not null").alias("k").join(fresh.alias("f"), ["source_id", "chunk_idx"])
    return both.where(F.col("k.fingerprint") != F.col("f.fingerprint")).select("source_id", "chunk_idx")
