"""Analytics over transfer runs: rates, stalls, latencies, mirrors, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds and samples of a rate window, and the least span that gives a rate.
RATE_SECONDS, RATE_SAMPLES, RATE_SPAN = 10, 64, 1.0
#: Samples that a resize looks at, and those it needs.
RESIZE_SAMPLES, RESIZE_LEAST = 64, 8
#: No second change of size within this time.
RESIZE_HOLD_US = 30_000_000
#: Transport failures that another attempt may mend.
PASSING = ["io", "tls", "transport", "no address"]


def progress_rate(samples: DataFrame, seconds: float = RATE_SECONDS, most: int = RATE_SAMPLES, span: float = RATE_SPAN) -> DataFrame:
    """``samples`` (key, at_us, bytes) with the rate over the last ``seconds``, at most ``most`` samples.

    Null if the span is too short or the counter went back.
    """
    by = W.partitionBy("key").orderBy("at_us")
    ranged = by.rangeBetween(-int(seconds * 1_000_000), 0)
    rows = by.rowsBetween(-(most - 1), 0)
    a = F.greatest(F.first("at_us").over(ranged), F.first("at_us").over(rows))
    # The later window start is the one with more bytes behind it unless the counter fell.
    b = F.when(F.first("at_us").over(ranged) >= F.first("at_us").over(rows), F.first("bytes").over(ranged)).otherwise(F.first("bytes").over(rows))
    took = (F.col("at_us") - a) / F.lit(1_000_000.0)
    return samples.withColumn("rate", F.when((took >= span) & (F.col("bytes") >= b), (F.col("bytes") - b) / took))


def stall_intervals(samples: DataFrame, threshold_us: int) -> DataFrame:
    """Samples at which a counter has not moved for ``threshold_us`` or more: key, at_us, stalled_us."""
    by = W.partitionBy("key").orderBy("at_us")
    moved = F.when(F.lag("bytes").over(by).isNull() | (F.lag("bytes").over(by) != F.col("bytes")), F.col("at_us"))
    since = F.last("moved", True).over(by.rowsBetween(W.unboundedPreceding, 0))
    return samples.withColumn("moved", moved).select("key", "at_us", (F.col("at_us") - since).alias("stalled_us")).where(F.col("stalled_us") >= threshold_us)


def bottleneck(download: Column, extract: Column, disk_bound: Column) -> Column:
    """Which side holds a run back: disk, or the rate more than a tenth below the other."""
    return (
        F.when(disk_bound, "disk")
        .when(download.isNull() | extract.isNull(), "unknown")
        .when(download < extract * 0.9, "network")
        .when(extract < download * 0.9, "decoder")
        .otherwise("balanced")
    )


def percent(done: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), done / total * 100.0))


def overall_percent(extracted: Column, estimate: Column, downloaded: Column, total: Column) -> Column:
    """Extraction progress where its total is known, else download progress."""
    return F.when(estimate > 0, percent(extracted, estimate)).when(total > 0, percent(downloaded, total))


def eta_seconds(downloaded: Column, total: Column, rate: Column, extracted: Column, estimate: Column, extract_rate: Column) -> Column:
    """The longer of what both sides still need; null if neither can be told."""
    a = F.when((rate > 0) & (downloaded < total), (total - downloaded) / rate)
    b = F.when((extract_rate > 0) & (extracted < estimate), (estimate - extracted) / extract_rate)
    return F.greatest(a, b)


def resize_decisions(samples: DataFrame, state: DataFrame, least: int, most: int, chunk: int, hold_us: int = RESIZE_HOLD_US) -> DataFrame:
    """key, n, p95_us, decision, size: whether each key's dispatch size changes now, and to what.

    ``state`` holds a row for each key: key, current, remaining (chunks), workers, changed_us (of the
    last change, or the start) and now_us.  Only the last 64 samples (key, at_us, seq, elapsed_us,
    retried) after the last change count.  Within ``hold_us`` of it, or with fewer than 8 samples, a
    key holds.  It halves, rounded up to whole chunks, if the 95th percentile (nearest rank) exceeds
    5 s or over a tenth were retried; it doubles, rounded down, if all took under 1 s and two chunks
    or more remain for each worker.  Sizes stay within ``least`` and ``most``.
    """
    since = samples.join(state.select("key", "changed_us"), "key").where("at_us > changed_us")
    last = since.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(F.desc("at_us"), F.desc("seq")))).where(F.col("rn") <= RESIZE_SAMPLES)
    g = last.groupBy("key").agg(
        F.count("*").alias("n"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_us)").cast("long").alias("p95_us"),
        F.max("elapsed_us").alias("slowest"), F.sum(F.col("retried").cast("long")).alias("retried"),
    )
    now = state.join(g, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    free = (F.col("now_us") - F.col("changed_us") >= hold_us) & (F.col("n") >= RESIZE_LEAST)
    slow = (F.col("p95_us") > 5_000_000) | (F.col("retried") * 10 > F.col("n"))
    plenty = F.col("remaining") >= F.greatest(F.col("workers"), F.lit(1)) * 2
    half, double = F.greatest(F.expr("current div 2"), F.lit(least)), F.least(F.col("current") * 2, F.lit(most))
    down = F.when(free & slow & (F.col("current") > least), F.least(half + F.pmod(-half, F.lit(chunk)), F.lit(most)))
    up = F.when(free & (F.col("slowest") < 1_000_000) & plenty & (F.col("current") < most), F.greatest(double - double % chunk, F.lit(least)))
    shrinks, grows = F.coalesce(down < F.col("current"), F.lit(False)), F.coalesce(up > F.col("current"), F.lit(False))
    return now.select(
        "key", "n", "p95_us", F.when(shrinks, "shrink").when(grows, "grow").otherwise("hold").alias("decision"),
        F.when(shrinks, down).when(grows, up).otherwise(F.col("current")).cast("long").alias("size"),
    )


def clamp_and_align(target: Column, least: int, most: int, chunk: int) -> Column:
    """``target`` within bounds, rounded down to whole chunks, never below the least whole number of chunks."""
    floor = -(-least // chunk) * chunk
    held = F.least(F.greatest(target, F.lit(least)), F.lit(most))
    return F.greatest(held - held % chunk, F.lit(floor)).cast("long")


def latency_ema(events: DataFrame) -> DataFrame:
    """mirror, ema_ns of the successes of ``events`` (mirror, at_us, seq, ok, latency_ns).

    The first latency counts whole; then previous div 8 * 7 + sample div 8, in integers.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at_us", "seq", "latency_ns"))), lambda x: x["latency_ns"])
    # A fold in order is inherently one per mirror; only three numbers per event travel.
    fold = F.aggregate("ordered", F.lit(None).cast("long"), lambda p, x: F.when(p.isNull(), x).otherwise((p - p % 8) / 8 * 7 + (x - x % 8) / 8).cast("long"))
    return events.where("ok").groupBy("mirror").agg(ordered.alias("ordered")).select("mirror", fold.alias("ema_ns"))


def mirror_exclusions(events: DataFrame, mirrors: DataFrame, hold_us: int = 30_000_000) -> DataFrame:
    """Each of ``events`` (source, mirror, at_us, seq, ok) with the time until which its mirror is left out.

    Null before any failure, and always for the only one of a source's ``mirrors`` (source, mirror).
    """
    several = mirrors.groupBy("source").agg((F.count_distinct("mirror") > 1).alias("several"))
    by = W.partitionBy("source", "mirror").orderBy("at_us", "seq").rowsBetween(W.unboundedPreceding, 0)
    until = F.when(~F.col("ok") & F.col("several"), F.col("at_us") + hold_us)
    return events.join(several, "source", "left").select("source", "mirror", "at_us", "seq", F.max(until).over(by).alias("excluded_until"))


def pick_mirrors(mirrors: DataFrame) -> DataFrame:
    """The best of each source's live mirrors (source, idx, in_flight, ema_ns, live): least load times latency."""
    score = (F.col("in_flight") + 1).cast("decimal(38,0)") * F.greatest(F.col("ema_ns"), F.lit(1)).cast("decimal(20,0)")
    ranked = mirrors.where("live").withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(score, "idx")))
    return ranked.where("rn = 1").select("source", "idx")


def backoff_schedule(attempts: int, base_ms: int, cap_ms: int) -> Column:
    """Delays in ms before each retry: doubling from ``base_ms`` up to ``cap_ms``."""
    k = F.sequence(F.lit(0), F.lit(attempts - 1))
    return F.transform(k, lambda i: F.least((F.lit(base_ms) * F.pow(F.lit(2.0), i)).cast("long"), F.lit(cap_ms).cast("long")))


def retryable(kind: Column, status: Column, cause: Column) -> Column:
    """Whether another attempt may succeed: server errors, bodies cut short or of the wrong length, and
    transport failures whose ``cause`` may pass.  A bad address, a bad answer, drift, a failed check, a
    cancelled run or a failed write is final."""
    return (
        F.coalesce(kind.isin("body", "length"), F.lit(False))
        | F.coalesce((kind == "transport") & cause.isin(PASSING), F.lit(False))
        | F.coalesce((kind == "status") & (status >= 500), F.lit(False))
    )
