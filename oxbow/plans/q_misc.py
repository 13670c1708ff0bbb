"""Queries over checksums, discovery, sinks and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from oxbow.functions import hashing, units
from oxbow.plans.catalog import query
from oxbow.plans.q_containers import open_blobs
from oxbow.plans.q_names import table
from oxbow.sources import containers, packers, transport


@query("checksums")
def checksums(spark, d):
    """No SQL engine at hand has these sums; tests hold them against published check values."""
    c = F.col("content")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return docs.select(
        "doc_id", F.crc32(c).alias("crc32"), hashing.crc16_rar(c).alias("crc16"), hashing.crc32c_of(c).alias("crc32c"), hashing.crc32_bzip2_of(c).alias("crc32_bzip2"),
        hashing.crc64_of(c).alias("crc64"), hashing.xxh64_of(c).alias("xxh64"), hashing.blake2sp_of(c).alias("blake2sp"),
    )


@query(
    "discover",
    """SELECT 'u' || s_suppkey AS url, CASE WHEN s_suppkey % 4 IN (0, 1) THEN (s_suppkey + 1) * 1000 WHEN s_suppkey % 4 = 2 THEN 777 ELSE 0 END AS total_size, s_suppkey % 4 <> 3 AS size_known,
    CASE s_suppkey % 4 WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS accept_ranges, CASE WHEN s_suppkey % 12 = 11 THEN 'unreachable' END AS error FROM supplier""",
)
def discover(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    none = F.lit(None)
    base = lambda method, status, length, ranges, cr: s.select(
        F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit(method).alias("method"), status.cast("int").alias("status"), length.cast("long").alias("length"), ranges.cast("boolean").alias("accept_ranges"),
        cr.cast("string").alias("content_range"), none.cast("string").alias("etag"), none.cast("string").alias("last_modified"),
    )
    head = base("HEAD", F.when(k % 12 == 11, 503).otherwise(200), F.when((k % 4).isin(0, 1), (k + 1) * 1000).otherwise(0), k % 4 == 0, none)
    probe = base("PROBE", F.when(k % 12 == 11, 500).when(k % 4 == 2, 206).otherwise(200), none, none, F.when(k % 4 == 2, "bytes 0-1/777"))
    return transport.discover(head.unionByName(probe)).drop("etag", "last_modified")


@query("discover_multi", "SELECT source AS source_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, bool_and(doc_id % 97 <> 0) AS size_known, bool_and(doc_id % 89 <> 0) AS accept_ranges, count(*) AS n_parts FROM documents GROUP BY 1")
def discover_multi(spark, d):
    k = F.col("doc_id")
    return transport.discover_parts(table(spark, d, "documents").select(F.col("source").alias("source_id"), F.octet_length("text").cast("long").alias("total_size"), (k % 97 != 0).alias("size_known"), (k % 89 != 0).alias("accept_ranges")))


@query("manifest", "SELECT trim(line, ' ') AS url FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#')")
def manifest(spark, d):
    return transport.manifest_lines(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query("classify_source", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'local' ELSE 'http' END AS kind FROM pages")
def classify_source(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "/data/")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", transport.classify(u).alias("kind"))


@query("disk_buffer", "SELECT p_partkey, s, ok, cap FROM (SELECT p_partkey, (['none', '64M', 'OFF', '0', 'x', '1Gi'])[1 + p_partkey % 6] AS s FROM part) JOIN (VALUES ('none', true, NULL), ('64M', true, 64000000), ('OFF', true, NULL), ('0', true, NULL), ('x', false, NULL), ('1Gi', true, 1073741824)) v(t, ok, c) ON s = t, LATERAL (SELECT CAST(c AS BIGINT) AS cap)")
def disk_buffer(spark, d):
    arr = F.array(*[F.lit(x) for x in ("none", "64M", "OFF", "0", "x", "1Gi")])
    s = table(spark, d, "part").select("p_partkey", F.get(arr, (F.col("p_partkey") % 6).cast("int")).alias("s"))
    return s.select("p_partkey", "s", units.parse_disk_buffer(F.col("s")).alias("b")).select("p_partkey", "s", "b.*")


@query("coder_label", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '00' WHEN 1 THEN '03:01:01' ELSE '06:F1:07:01' END AS label FROM nation")
def coder_label(spark, d):
    from oxbow.functions.misc import hex_label

    raw = F.when(F.col("n_nationkey") % 3 == 0, "00").when(F.col("n_nationkey") % 3 == 1, "030101").otherwise("06f10701")
    return table(spark, d, "nation").select("n_nationkey", hex_label(F.unhex(raw)).alias("label"))


@query("exit_codes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 128 + event_id % 30 ELSE 1 END AS code FROM events")
def exit_codes(spark, d):
    from oxbow.functions.misc import exit_code

    e = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("ok", "failed", "usage", "resume", "signal", "other")]), (e % 6).cast("int"))
    return table(spark, d, "events").select("event_id", exit_code(kind, e % 30).alias("code"))


@query("vint", "SELECT o_orderkey AS value, o_orderkey AS decoded FROM orders")
def vint(spark, d):
    from oxbow.functions.misc import vint_bytes, vint_value

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("value"), vint_value(vint_bytes(F.col("o_orderkey"))).alias("decoded"))


@query("filetime", "SELECT o_orderkey, epoch_us(o_orderdate) AS micros FROM orders")
def filetime(spark, d):
    from oxbow.functions.misc import filetime_timestamp

    micros = F.expr("unix_micros(cast(o_orderdate as timestamp))")
    return table(spark, d, "orders").withColumn("t", filetime_timestamp((micros + 11644473600000000) * 10)).select("o_orderkey", F.expr("unix_micros(t)").alias("micros"))


@query("alignment", "SELECT o_orderkey, o_orderkey - o_orderkey % 512 AS down, (o_orderkey + 511) // 512 * 512 AS up FROM orders")
def alignment(spark, d):
    from oxbow.functions.misc import align_down, align_up

    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", align_down(k, 512).alias("down"), align_up(k, 512).alias("up"))


@query("token_bucket")
def token_bucket(spark, d):
    from oxbow.streaming.ingest import token_bucket as bucket

    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.expr("unix_micros(cast(ts as timestamp))").alias("at_us"), F.floor(F.col("value") * 100000).cast("long").alias("bytes"))
    return bucket(e, 100, least=1 << 20)


@query("stream_ingest", "SELECT source || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents")
def stream_ingest(spark, d):
    """Archives of the documents come in as a stream, in small batches, and are read back."""
    from oxbow.sources.staging import shared_folder
    from oxbow.streaming.ingest import ingest

    base = shared_folder(spark, "ingest")
    blobs = packers.pack_documents(table(spark, d, "documents"), "zip").withColumn("container", F.lit("zip"))
    blobs.select("source_id", "container", "content").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("source_id string, container string, content binary").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    ingest(stream, f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "size", "sha256")


@query("safe_sink", "SELECT source || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def safe_sink(spark, d):
    """Archives are unpacked to a tree of files and read back from it."""
    from oxbow.sources.staging import shared_folder
    from oxbow.sources.sinks import write_tree

    base = shared_folder(spark, "tree")
    blobs = packers.pack_documents(table(spark, d, "documents"), "tar", ".zst")
    write_tree(containers.read_entries(open_blobs(blobs), content=True), base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(base)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


@query("substreams", "SELECT source AS source_id, doc_id // 1280 AS part, row_number() OVER (PARTITION BY source, doc_id // 1280 ORDER BY doc_id) - 1 AS k, sha256(text) AS sha256 FROM documents")
def substreams(spark, d):
    """Streams of at most some hundred documents of a source, cut again at their declared sizes."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents").selectExpr("source", "doc_id div 1280 as part", "doc_id", "text")
    w = W.partitionBy("source", "part").orderBy("doc_id")
    end = F.sum(F.octet_length("text").cast("long")).over(w)
    cuts = docs.select("source", "part", (F.row_number().over(w) - 1).cast("long").alias("k"), (end - F.octet_length("text")).alias("at"), F.octet_length("text").alias("n"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("text").cast("binary").alias("b")))), lambda x: x["b"])
    whole = docs.groupBy("source", "part").agg(bodies.alias("p")).select("source", "part", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x))").alias("stream"))
    return cuts.join(whole, ["source", "part"]).select(F.col("source").alias("source_id"), "part", "k", F.sha2(F.expr("substring(stream, cast(at + 1 as int), n)"), 256).alias("sha256"))
