"""Queries over transfer runs: events stand for samples, outcomes and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from oxbow.functions import units
from oxbow.operators import analytics as A
from oxbow.plans.catalog import query
from oxbow.plans.q_names import table


def _counters(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts")
    step = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.expr("unix_micros(cast(ts as timestamp))").alias("at_us"), F.sum(step).over(w).alias("bytes"))


_COUNTERS = "c AS (SELECT user_id AS key, epoch_us(ts) AS at_us, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS bytes FROM events)"
_HOURS = 6 * 3600


@query(
    "progress_rate",
    f"""WITH {_COUNTERS}, w AS (SELECT *, first(at_us) OVER r AS a1, first(at_us) OVER n AS a2, first(bytes) OVER r AS b1, first(bytes) OVER n AS b2 FROM c
      WINDOW r AS (PARTITION BY key ORDER BY at_us RANGE BETWEEN {_HOURS}000000 PRECEDING AND CURRENT ROW), n AS (PARTITION BY key ORDER BY at_us ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
    x AS (SELECT *, greatest(a1, a2) AS a, CASE WHEN a1 >= a2 THEN b1 ELSE b2 END AS b FROM w)
    SELECT key, at_us, bytes, CASE WHEN (at_us - a) / 1000000.0 >= 1 AND bytes >= b THEN round((bytes - b) / ((at_us - a) / 1000000.0), 6) END AS rate FROM x""",
)
def progress_rate(spark, d):
    return A.progress_rate(_counters(spark, d), seconds=_HOURS).withColumn("rate", F.round("rate", 6))


@query(
    "stall_intervals",
    f"""WITH {_COUNTERS}, m AS (SELECT *, CASE WHEN lag(bytes) OVER w IS NULL OR lag(bytes) OVER w <> bytes THEN at_us END AS moved FROM c WINDOW w AS (PARTITION BY key ORDER BY at_us)),
    s AS (SELECT key, at_us, at_us - last_value(moved IGNORE NULLS) OVER (PARTITION BY key ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS stalled_us FROM m) SELECT * FROM s WHERE stalled_us >= 3600000000""",
)
def stall_intervals(spark, d):
    return A.stall_intervals(_counters(spark, d), 3_600_000_000)


@query(
    "bottleneck",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS a, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size * 40.0 END AS b, p_partkey % 11 = 0 AS disk FROM part)
    SELECT p_partkey, CASE WHEN disk THEN 'disk' WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a < b * CAST(0.9 AS DOUBLE) THEN 'network' WHEN b < a * CAST(0.9 AS DOUBLE) THEN 'decoder' ELSE 'balanced' END AS side FROM t""",
)
def bottleneck(spark, d):
    k = F.col("p_partkey")
    a, b = F.when(k % 13 != 0, F.col("p_retailprice")), F.when(k % 17 != 0, F.col("p_size") * 40.0)
    return table(spark, d, "part").select("p_partkey", A.bottleneck(a, b, k % 11 == 0).alias("side"))


@query(
    "eta",
    """WITH t AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS total, CAST(floor(o_totalprice) AS BIGINT) // (1 + o_orderkey % 5) AS done, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS r,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 2) AS BIGINT) END AS est, CAST(floor(o_totalprice) AS BIGINT) // 2 AS ex FROM orders),
    u AS (SELECT *, CASE WHEN r > 0 AND done < total THEN (total - done) / r END AS a, CASE WHEN ex < est THEN (est - ex) / CAST(77 AS DOUBLE) END AS b FROM t)
    SELECT k AS o_orderkey, CAST(floor(greatest(a, b)) AS BIGINT) AS seconds, round(CASE WHEN est > 0 THEN least(100.0, greatest(0.0, ex / CAST(est AS DOUBLE) * 100.0)) WHEN total > 0 THEN least(100.0, greatest(0.0, done / CAST(total AS DOUBLE) * 100.0)) END, 6) AS percent FROM u""",
)
def eta(spark, d):
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    done = F.floor(total / (1 + k % 5)).cast("long")
    rate = F.when(k % 7 != 0, (k % 90).cast("double"))
    est, ex = F.when(k % 3 != 0, F.floor(F.col("o_totalprice") * 2).cast("long")), F.floor(total / 2).cast("long")
    return table(spark, d, "orders").select(
        "o_orderkey", F.floor(A.eta_seconds(done, total, rate, ex, est, F.lit(77.0))).cast("long").alias("seconds"), F.round(A.overall_percent(ex, est, done, total), 6).alias("percent")
    )


_SHOWN = "n || ' B/s'"
for _k, _unit in enumerate(units.UNITS[1:], 1):
    _SHOWN = f"CASE WHEN n >= {1024**_k} THEN CAST(CAST(round_even(n / CAST({1024**_k} AS DOUBLE), 1) AS DECIMAL(20,1)) AS VARCHAR) || ' {_unit}/s' ELSE {_SHOWN} END"


@query(
    "format_rate",
    f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '—' ELSE {_SHOWN} END AS shown
    FROM (SELECT event_id, CAST(floor(value * 100 * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END + 0.5) AS BIGINT) AS n FROM events)""",
)
def format_rate(spark, d):
    e = F.col("event_id")
    scale = F.when(e % 4 == 0, 1.0).when(e % 4 == 1, 1e3).when(e % 4 == 2, 1e6).otherwise(1e9)
    rate = F.when(e % 9 == 0, F.lit(-1.0)).otherwise(F.col("value") * 100 * scale)
    return table(spark, d, "events").select("event_id", units.format_rate(rate).alias("shown"))


@query(
    "resize_decision",
    """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS us_at, event_id, CAST(floor(value * CASE WHEN user_id % 2 = 0 THEN 100000 ELSE 1000 END) AS BIGINT) AS us, event_type = 'error' AND user_id % 4 <> 1 AS retried FROM events),
    st AS (SELECT key, max(us_at) AS now_us, CASE key % 3 WHEN 0 THEN max(us_at) - 10000000 WHEN 1 THEN min(us_at) - 1 ELSE (min(us_at) + max(us_at)) // 2 END AS changed_us,
      65536 * (2 + key % 15) AS cur, key % 40 AS remaining, key % 8 AS workers FROM e GROUP BY key),
    s AS (SELECT e.*, row_number() OVER (PARTITION BY e.key ORDER BY us_at DESC, event_id DESC) AS rn FROM e JOIN st ON e.key = st.key AND us_at > changed_us),
    g AS (SELECT key, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY us) AS p95_us, max(us) AS slow, count(*) FILTER (retried) AS r FROM s WHERE rn <= 64 GROUP BY key),
    f AS (SELECT st.*, coalesce(n, 0) AS n, p95_us, slow, r, now_us - changed_us >= 30000000 AND n >= 8 AS free FROM st LEFT JOIN g ON g.key = st.key),
    h AS (SELECT *, CASE WHEN free AND (p95_us > 5000000 OR r * 10 > n) AND cur > 131072 THEN least((greatest(cur // 2, 131072) + 65535) // 65536 * 65536, 1000000) END AS down,
      CASE WHEN free AND slow < 1000000 AND remaining >= 2 * greatest(workers, 1) AND cur < 1000000 THEN greatest(least(cur * 2, 1000000) // 65536 * 65536, 131072) END AS up FROM f)
    SELECT key, n, p95_us, CASE WHEN down < cur THEN 'shrink' WHEN up > cur THEN 'grow' ELSE 'hold' END AS decision, CASE WHEN down < cur THEN down WHEN up > cur THEN up ELSE cur END AS size FROM h""",
)
def resize_decision(spark, d):
    k, at = F.col("user_id"), F.expr("unix_micros(cast(ts as timestamp))")
    elapsed = F.floor(F.col("value") * F.when(k % 2 == 0, 100000).otherwise(1000)).cast("long")
    samples = table(spark, d, "events").select(
        k.alias("key"), at.alias("at_us"), F.col("event_id").alias("seq"), elapsed.alias("elapsed_us"), ((F.col("event_type") == "error") & (k % 4 != 1)).alias("retried")
    )
    changed = F.expr("CASE key % 3 WHEN 0 THEN max(at_us) - 10000000 WHEN 1 THEN min(at_us) - 1 ELSE (min(at_us) + max(at_us)) div 2 END")
    state = samples.groupBy("key").agg(F.max("at_us").alias("now_us"), changed.alias("changed_us")).selectExpr(
        "*", "65536 * (2 + key % 15) AS current", "key % 40 AS remaining", "key % 8 AS workers"
    )
    return A.resize_decisions(samples, state, 131072, 1_000_000, 65536)


@query("clamp_and_align", "SELECT o_orderkey, greatest(h - h % 4096, 20480) AS bytes FROM (SELECT o_orderkey, least(greatest(CAST(floor(o_totalprice) AS BIGINT), 18000), 300000) AS h FROM orders)")
def clamp_and_align(spark, d):
    return table(spark, d, "orders").select("o_orderkey", A.clamp_and_align(F.floor("o_totalprice").cast("long"), 18000, 300000, 4096).alias("bytes"))


def _outcomes(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("mirror"), F.expr("unix_micros(cast(ts as timestamp))").alias("at_us"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") * 1000).cast("long").alias("latency_ns")
    )


@query(
    "mirror_ema",
    "SELECT user_id AS mirror, list_reduce(list(CAST(floor(value * 1000) AS BIGINT) ORDER BY epoch_us(ts), event_id), lambda p, x: p // 8 * 7 + x // 8) AS ema_ns FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def mirror_ema(spark, d):
    return A.latency_ema(_outcomes(spark, d))


@query(
    "mirror_exclusion",
    """WITH e AS (SELECT CASE WHEN user_id % 3 = 0 THEN -user_id ELSE user_id % 50 END AS source, user_id AS mirror, epoch_us(ts) AS at_us, event_id AS seq, event_type = 'error' AS bad FROM events),
    m AS (SELECT source FROM e GROUP BY source HAVING count(DISTINCT mirror) > 1)
    SELECT source, mirror, at_us, seq, max(CASE WHEN bad AND source IN (SELECT source FROM m) THEN at_us + 30000000 END) OVER (PARTITION BY source, mirror ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS excluded_until FROM e""",
)
def mirror_exclusion(spark, d):
    k = F.col("mirror")
    events = _outcomes(spark, d).withColumn("source", F.when(k % 3 == 0, -k).otherwise(k % 50))
    return A.mirror_exclusions(events, events.select("source", "mirror").distinct())


@query(
    "mirror_pick",
    "SELECT CAST(s_nationkey AS BIGINT) AS source, arg_min(s_suppkey, (s_suppkey % 5 + 1) * greatest(CAST(floor(s_acctbal) AS BIGINT), 1) * 1000000 + s_suppkey) AS idx FROM supplier WHERE s_suppkey % 6 <> 0 GROUP BY 1",
)
def mirror_pick(spark, d):
    k = F.col("s_suppkey")
    m = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("source"), k.alias("idx"), (k % 5).alias("in_flight"), F.floor("s_acctbal").cast("long").alias("ema_ns"), (k % 6 != 0).alias("live"))
    return A.pick_mirrors(m)


@query(
    "mirror_agreement",
    """WITH p AS (SELECT s_nationkey AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1)
    SELECT s.s_suppkey AS mirror, CASE WHEN s.s_suppkey % 8 = 0 THEN 'head failed' WHEN s.s_suppkey % 3 <> f.s_suppkey % 3 THEN 'size mismatch' WHEN s.s_suppkey % 2 <> f.s_suppkey % 2 THEN 'fingerprint mismatch' ELSE 'kept' END AS outcome
    FROM supplier s JOIN p ON p.n = s.s_nationkey JOIN supplier f ON f.s_suppkey = p.first WHERE s.s_suppkey <> p.first""",
)
def mirror_agreement(spark, d):
    from oxbow.functions.urls import fingerprints_agree

    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select("s_nationkey", k.alias("idx"), (k % 3).alias("size"), (k % 2).cast("string").alias("etag"), (k % 8 == 0).alias("failed"))
    first = rows.groupBy("s_nationkey").agg(F.min_by(F.struct("idx", "size", "etag"), "idx").alias("p"))
    none = F.lit(None).cast("string")
    j = rows.join(first, "s_nationkey").where(F.col("idx") != F.col("p.idx"))
    outcome = F.when(F.col("failed"), "head failed").when(F.col("size") != F.col("p.size"), "size mismatch").when(~fingerprints_agree(F.col("etag"), none, F.col("p.etag"), none), "fingerprint mismatch").otherwise("kept")
    return j.select(F.col("idx").alias("mirror"), outcome.alias("outcome"))


@query("retry_backoff", "SELECT n_nationkey, k AS attempt, least(100 * (1 << k), 10000) AS delay_ms FROM (SELECT n_nationkey, unnest(range(8)) AS k FROM nation)")
def retry_backoff(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(A.backoff_schedule(8, 100, 10_000)).alias("attempt", "delay_ms")).withColumn("attempt", F.col("attempt").cast("long"))


@query(
    "retryable",
    """WITH t(k, kind) AS (VALUES (0, 'transport'), (1, 'body'), (2, 'status'), (3, 'drift'), (4, 'length'), (5, 'range'), (6, 'cancelled')),
    c(k, cause) AS (VALUES (0, 'io'), (1, 'tls'), (2, 'url'), (3, 'no address'), (4, 'name'))
    SELECT event_id, kind, cause, kind IN ('body', 'length') OR (kind = 'status' AND 400 + event_id % 200 >= 500) OR (kind = 'transport' AND cause NOT IN ('url', 'name')) AS retry
    FROM events JOIN t ON t.k = event_id % 7 JOIN c ON c.k = event_id % 5""",
)
def retryable(spark, d):
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ["transport", "body", "status", "drift", "length", "range", "cancelled"]))
    causes = F.array(*map(F.lit, ["io", "tls", "url", "no address", "name"]))
    rows = table(spark, d, "events").select("event_id", F.get(kinds, (e % 7).cast("int")).alias("kind"), F.get(causes, (e % 5).cast("int")).alias("cause"))
    return rows.withColumn("retry", A.retryable(F.col("kind"), 400 + e % 200, F.col("cause")))


@query(
    "run_stats",
    "SELECT o_orderpriority AS run, count(*) AS chunks, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, CAST(sum(o_orderkey % 4) AS BIGINT) AS retries, round(exp(avg(ln(o_totalprice))), 4) AS geomean FROM orders GROUP BY 1",
)
def run_stats(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.count("*").alias("chunks"), F.sum(F.floor("o_totalprice")).alias("bytes"), F.sum(F.col("o_orderkey") % 4).alias("retries"), F.round(F.exp(F.avg(F.log("o_totalprice"))), 4).alias("geomean")
    )
