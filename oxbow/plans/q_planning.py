"""Queries over chunks, parts, dispatches and entry rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from oxbow.functions import hashing
from oxbow.operators import entries, planning, resume
from oxbow.plans.catalog import query
from oxbow.plans.q_names import table

CHUNK = 1024


def _sources(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("total_size"))


_SIZE = "octet_length(encode(text))"


@query("chunk_count", f"SELECT doc_id AS source_id, CASE WHEN {_SIZE} > 0 THEN CAST(({_SIZE} + 1023) // 1024 AS BIGINT) END AS n_chunks FROM documents")
def chunk_count(spark, d):
    return _sources(spark, d).select("source_id", planning.chunk_count(F.col("total_size"), CHUNK).alias("n_chunks"))


@query(
    "chunk_plan",
    f'SELECT source_id, k AS chunk_idx, k * 1024 AS "start", least((k + 1) * 1024, n) AS end_excl FROM (SELECT doc_id AS source_id, {_SIZE} AS n, unnest(range(({_SIZE} + 1023) // 1024)) AS k FROM documents)',
)
def chunk_plan(spark, d):
    return planning.chunks(_sources(spark, d), CHUNK)


@query(
    "chunk_fingerprints",
    f"""WITH RECURSIVE r(b, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0x82F63B78}) ELSE c >> 1 END FROM r WHERE k < 8),
    t AS (SELECT list(c ORDER BY b) AS tab FROM r WHERE k = 8),
    p AS (SELECT doc_id, k AS chunk_idx, substr(h, CAST(k * 2048 + 1 AS BIGINT), 2048) AS h FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(({_SIZE} + 1023) // 1024)) AS k FROM documents)),
    x AS (SELECT doc_id, chunk_idx, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM p)
    SELECT doc_id, chunk_idx, xor(list_reduce(bytes, lambda c, y: xor(tab[1 + (xor(c, y) & 255)], c >> 8)), CAST(4294967295 AS BIGINT)) AS crc32c FROM x, t""",
)
def chunk_fingerprints(spark, d):
    """CRC-32C of each chunk of bytes; null and empty texts have no chunk."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = F.floor((F.octet_length("content") + (CHUNK - 1)) / CHUNK).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("long").alias("chunk_idx"), F.substring("content", k * CHUNK + 1, F.lit(CHUNK)).alias("part")))
    chunks = docs.where(F.octet_length("content") > 0).select("doc_id", F.explode(at).alias("c"))
    return chunks.select("doc_id", "c.chunk_idx", hashing.crc32c_of(F.col("c.part")).alias("crc32c"))


def _parts(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("part_idx"), F.octet_length("text").cast("long").alias("size"))


_BOUNDS = f"""b AS (SELECT source AS source_id, doc_id AS part_idx, {_SIZE} AS size, CAST(sum({_SIZE}) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS end_off FROM documents),
bounds AS (SELECT *, end_off - size AS start_off FROM b)"""


@query("part_boundaries", f"WITH {_BOUNDS} SELECT source_id, part_idx, size, start_off, end_off FROM bounds")
def part_boundaries(spark, d):
    return planning.part_bounds(_parts(spark, d)).select("source_id", "part_idx", "size", "start_off", "end_off")


def _offsets(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("source_id"), (F.col("event_id") * 37).alias("offset")).distinct()


_OFFSETS = "o AS (SELECT DISTINCT 'src' || (event_id % 20) AS source_id, event_id * 37 AS \"offset\" FROM events)"


@query("part_locate", f'WITH {_BOUNDS}, {_OFFSETS} SELECT o.source_id, o."offset", part_idx, o."offset" - start_off AS in_part FROM o JOIN bounds USING (source_id) WHERE o."offset" >= start_off AND o."offset" < end_off')
def part_locate(spark, d):
    return planning.locate(_offsets(spark, d), planning.part_bounds(_parts(spark, d)))


@query("next_part_boundary", f'WITH {_BOUNDS}, {_OFFSETS} SELECT o.source_id, o."offset", min(end_off) AS boundary FROM o LEFT JOIN bounds b ON o.source_id = b.source_id AND b.end_off > o."offset" GROUP BY 1, 2')
def next_part_boundary(spark, d):
    return planning.next_boundary(_offsets(spark, d), planning.part_bounds(_parts(spark, d)))


@query(
    "dispatch_segments",
    f"""WITH {_BOUNDS}, t AS (SELECT source_id, max(end_off) AS n FROM bounds GROUP BY 1), c AS (SELECT source_id, k * 4096 AS s, least((k + 1) * 4096, n) AS e FROM (SELECT source_id, n, unnest(range((n + 4095) // 4096)) AS k FROM t))
    SELECT c.source_id, s AS dispatch_start, part_idx, greatest(s, start_off) - start_off AS part_start, least(e, end_off) - start_off AS part_end, greatest(s, start_off) AS global_start, least(e, end_off) AS global_end
    FROM c JOIN bounds USING (source_id) WHERE s < end_off AND start_off < e""",
)
def dispatch_segments(spark, d):
    bounds = planning.part_bounds(_parts(spark, d))
    totals = _parts(spark, d).groupBy("source_id").agg(F.sum("size").alias("total_size"))
    return planning.segments(planning.chunks(totals, 4096), bounds)


def _states(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("source_id"), k.cast("long").alias("chunk_idx"), (F.col("o_orderstatus") == "F").alias("complete"))


_STATES = "s AS (SELECT o_custkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chunk_idx, o_orderstatus = 'F' AS complete FROM orders)"


@query("bitmap_pack", f"WITH {_STATES} SELECT source_id, chunk_idx // 8 AS byte_idx, CAST(sum(CASE WHEN complete THEN 1 << CAST(chunk_idx % 8 AS INTEGER) ELSE 0 END) AS BIGINT) AS byte FROM s GROUP BY 1, 2")
def bitmap_pack(spark, d):
    return planning.pack_bits(_states(spark, d))


@query("bitmap_unpack", f"WITH {_STATES} SELECT source_id, chunk_idx, complete FROM s")
def bitmap_unpack(spark, d):
    s = _states(spark, d)
    return planning.unpack_bits(planning.pack_bits(s), s.groupBy("source_id").agg(F.count("*").alias("n")))


@query(
    "next_incomplete",
    f"WITH {_STATES} SELECT source_id, coalesce(min(chunk_idx) FILTER (NOT complete AND chunk_idx >= 5), min(chunk_idx) FILTER (NOT complete)) AS next_chunk, count(*) FILTER (complete) AS n_complete FROM s GROUP BY 1",
)
def next_incomplete(spark, d):
    return planning.next_incomplete(_states(spark, d), 5)


@query(
    "dispatch_coalesce",
    f"""WITH {_STATES}, o AS (SELECT source_id, chunk_idx, chunk_idx - row_number() OVER (PARTITION BY source_id ORDER BY chunk_idx) AS run FROM s WHERE NOT complete),
    p AS (SELECT *, (row_number() OVER (PARTITION BY source_id, run ORDER BY chunk_idx) - 1) // 3 AS cut FROM o)
    SELECT source_id, min(chunk_idx) AS first_chunk, count(*) AS n_chunks FROM p GROUP BY source_id, run, cut""",
)
def dispatch_coalesce(spark, d):
    return planning.coalesce_dispatches(_states(spark, d), 3)


_PART_STATES = f"""{_BOUNDS}, t AS (SELECT source_id, max(end_off) AS n FROM bounds GROUP BY 1),
c AS (SELECT source_id, unnest(range((n + 4095) // 4096)) AS k FROM t), o AS (SELECT source_id, k FROM c WHERE k % 7 <> 2)"""


@query(
    "dispatch_within_parts",
    f"""WITH RECURSIVE {_PART_STATES}, r AS (SELECT source_id, k, (SELECT min(end_off) FROM bounds b WHERE b.source_id = o.source_id AND end_off > (k + 1) * 4096 - 1) AS c0, (SELECT max(end_off) FROM bounds b WHERE b.source_id = o.source_id) AS top FROM o),
    q AS (SELECT *, coalesce(c0, top) AS cap, row_number() OVER (PARTITION BY source_id ORDER BY k) AS rn FROM r),
    f AS (SELECT source_id, k, rn, k AS first_chunk, 1 AS n, cap FROM q WHERE rn = 1 UNION ALL
      SELECT q.source_id, q.k, q.rn, CASE WHEN j THEN f.first_chunk ELSE q.k END, CASE WHEN j THEN f.n + 1 ELSE 1 END, CASE WHEN j THEN f.cap ELSE q.cap END
      FROM (SELECT f.*, q.k AS nk, q.k = f.first_chunk + f.n AND f.n < 4 AND q.k * 4096 < f.cap AS j FROM f JOIN q ON q.source_id = f.source_id AND q.rn = f.rn + 1) f JOIN q ON q.source_id = f.source_id AND q.rn = f.rn + 1)
    SELECT source_id, CAST(first_chunk AS BIGINT) AS first_chunk, CAST(max(n) AS BIGINT) AS n_chunks FROM f GROUP BY 1, 2""",
)
def dispatch_within_parts(spark, d):
    totals = _parts(spark, d).groupBy("source_id").agg(F.sum("size").alias("total_size"))
    states = planning.chunks(totals, 4096).select("source_id", "chunk_idx", (F.col("chunk_idx") % 7 == 2).alias("complete"))
    return planning.coalesce_within_parts(states, planning.part_bounds(_parts(spark, d)), 4, 4096)


def _entries(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey")
    return li.select(
        F.col("l_suppkey").alias("source_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry_idx"),
        F.concat(F.lit("d"), (k % 5).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/f"), (k % 11).cast("string"))).otherwise("")).alias("path"),
        F.when(k % 4 == 0, "symlink").when(k % 4 == 1, "hardlink").otherwise("file").alias("type"),
        F.concat(F.lit("d"), (k % 7).cast("string")).alias("link_target"),
    )


_ENTRIES = """e AS (SELECT l_suppkey AS source_id, l_orderkey * 8 + l_linenumber AS entry_idx, 'd' || (l_partkey % 5) || CASE WHEN l_partkey % 3 = 0 THEN '/f' || (l_partkey % 11) ELSE '' END AS path,
CASE l_partkey % 4 WHEN 0 THEN 'symlink' WHEN 1 THEN 'hardlink' ELSE 'file' END AS type, 'd' || (l_partkey % 7) AS link_target FROM lineitem)"""


@query("dedupe_last_entry", f"WITH {_ENTRIES} SELECT source_id, path, max(entry_idx) AS entry_idx FROM e GROUP BY 1, 2")
def dedupe_last_entry(spark, d):
    return entries.last_entry_wins(_entries(spark, d)).select("source_id", "path", "entry_idx")


@query("hardlink_resolve", f"WITH {_ENTRIES} SELECT source_id, entry_idx, path, link_target FROM e WHERE type = 'hardlink' AND EXISTS (SELECT 1 FROM e f WHERE f.source_id = e.source_id AND f.type = 'file' AND f.path = e.link_target AND f.entry_idx < e.entry_idx)")
def hardlink_resolve(spark, d):
    return entries.resolvable_hardlinks(_entries(spark, d)).select("source_id", "entry_idx", "path", "link_target")


@query("symlink_traversal", f"WITH {_ENTRIES} SELECT DISTINCT source_id, entry_idx, path FROM e WHERE contains(path, '/') AND EXISTS (SELECT 1 FROM e f WHERE f.source_id = e.source_id AND f.type = 'symlink' AND f.path = string_split(e.path, '/')[1] AND f.entry_idx < e.entry_idx)")
def symlink_traversal(spark, d):
    return entries.through_symlinks(_entries(spark, d))


@query("unfinished_entries", f"WITH {_ENTRIES} SELECT source_id, entry_idx, path FROM e WHERE entry_idx % 3 <> 0")
def unfinished_entries(spark, d):
    e = _entries(spark, d)
    return entries.unfinished(e, e.where("entry_idx % 3 = 0").select("source_id", "entry_idx")).select("source_id", "entry_idx", "path")


def _runs(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    prior = o.where(k % 19 != 0).select(
        k.alias("source_id"), F.lit("http").alias("mode"), F.concat(F.lit("https://h/"), k.cast("string")).alias("url"), F.floor("o_totalprice").cast("long").alias("total_size"), (k % 4).alias("n_parts"), F.lit(1024).alias("chunk_size"),
        F.when(k % 3 == 0, F.concat(F.lit('W/"'), k.cast("string"))).otherwise(k.cast("string")).alias("etag"), F.when(k % 2 == 0, F.col("o_orderdate").cast("string")).alias("last_modified"), F.lit("tar").alias("sink"),
    )
    now = o.where(k % 23 != 0).select(
        k.alias("source_id"), F.when(k % 29 == 0, "local").otherwise("http").alias("mode"), F.concat(F.lit("https://h/"), F.when(k % 31 == 0, k + 1).otherwise(k).cast("string")).alias("url"), (F.floor("o_totalprice").cast("long") + F.when(k % 13 == 0, 1).otherwise(0)).alias("total_size"),
        (k % 4 + F.when(k % 17 == 0, 1).otherwise(0)).alias("n_parts"), F.when(k % 37 == 0, 2048).otherwise(1024).alias("chunk_size"), F.when(k % 7 == 0, "changed").when(k % 3 == 0, F.concat(F.lit('W/"'), k.cast("string"))).otherwise(k.cast("string")).alias("etag"),
        F.when(k % 11 == 0, "moved").when(k % 2 == 0, F.col("o_orderdate").cast("string")).alias("last_modified"), F.when(k % 41 == 0, "zip").otherwise("tar").alias("sink"),
    )
    return prior, now


@query(
    "resume_plan",
    """SELECT o_orderkey AS source_id, CASE WHEN k % 23 = 0 THEN 'gone' WHEN k % 19 = 0 THEN 'new' WHEN k % 29 = 0 THEN 'mode' WHEN k % 31 = 0 THEN 'url' WHEN k % 13 = 0 THEN 'total size' WHEN k % 17 = 0 THEN 'part count'
      WHEN k % 37 = 0 THEN 'chunk size' WHEN (k % 3 <> 0 AND k % 7 = 0) OR (k % 2 = 0 AND k % 11 = 0) THEN 'fingerprint' WHEN k % 41 = 0 THEN 'sink' END AS verdict
    FROM (SELECT *, o_orderkey AS k FROM orders) WHERE NOT (k % 19 = 0 AND k % 23 = 0)""",
)
def resume_plan(spark, d):
    return resume.resume_plan(*_runs(spark, d))


@query("drift_audit", "SELECT doc_id AS source_id, doc_id % 4 AS chunk_idx FROM documents WHERE doc_id % 10 = 3 AND doc_id % 9 <> 0 AND sha256(text) <> sha256(text || 'x')")
def drift_audit(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    kept = docs.select(k.alias("source_id"), (k % 4).alias("chunk_idx"), F.when(k % 9 != 0, F.sha2("text", 256)).alias("fingerprint"))
    fresh = docs.select(k.alias("source_id"), (k % 4).alias("chunk_idx"), F.sha2(F.when(k % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("fingerprint"))
    return resume.drifted_chunks(kept, fresh)
