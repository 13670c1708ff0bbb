"""Round trips: documents are packed into archives, which the engine routes, decodes and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.functions.names import Registry
from oxbow.plans.catalog import query
from oxbow.plans.q_names import table
from oxbow.sources import codecs, containers, packers

_LISTING = "SELECT source || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents"


def open_blobs(blobs: DataFrame) -> DataFrame:
    """source_id, container, content of ``blobs`` (source_id, name, content): the format is
    found by name and signature; streams are decoded and looked at again."""
    r = Registry()
    routed = blobs.withColumn("fmt", r.resolve(F.col("name"), F.substring("content", 1, r.window()))["format"])
    stream = r.shape(F.col("fmt")) == "stream"
    plain = codecs.decode_stream(F.when(stream, F.col("fmt")).otherwise("identity"), F.col("content"))["content"]
    inner = routed.select("source_id", "fmt", stream.alias("stream"), plain.alias("content"))
    return inner.select("source_id", F.when(F.col("stream"), r.by_magic(F.substring("content", 1, r.window()))).otherwise(F.col("fmt")).alias("container"), "content")


def _round_trip(container: str, wrapper: str = "", **options):
    def run(spark, d):
        blobs = packers.pack_documents(table(spark, d, "documents"), container, wrapper, **options)
        return containers.read_entries(open_blobs(blobs)).select("path", "size", "sha256")

    return run


for _name, _args in {
    "tar_listing": ("tar",), "tar_gz_listing": ("tar", ".gz"), "tar_bz2_listing": ("tar", ".bz2"), "tar_xz_listing": ("tar", ".xz"), "tar_zst_listing": ("tar", ".zst"), "tar_lz4_listing": ("tar", ".lz4"),
    "sevenz_listing": ("7z",), "rar5_stored_listing": ("rar",), "zip_listing": ("zip",),
}.items():
    query(_name, _LISTING)(_round_trip(*_args))
for _method in ("stored", "zstd"):
    query(f"zip_{_method}_listing", _LISTING)(_round_trip("zip", method=_method))
for _coder in ("Copy", "Deflate"):
    query(f"sevenz_{_coder.lower()}_listing", _LISTING)(_round_trip("7z", coder=_coder))


def _sealed_trip(container: str, **options):
    def run(spark, d):
        blobs = packers.pack_documents(table(spark, d, "documents"), container, password="open sesame", **options)
        return containers.read_entries(open_blobs(blobs), password="open sesame").select("path", "size", "sha256")

    return run


query("zip_aes_listing", _LISTING)(_sealed_trip("zip"))
query("zip_aes128_stored_listing", _LISTING)(_sealed_trip("zip", method="stored", strength=1))
query("sevenz_aes_listing", _LISTING)(_sealed_trip("7z"))


@query("entry_prune", "SELECT source || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 = 7 AND octet_length(encode(text)) > 1000")
def entry_prune(spark, d):
    """Only the wanted entries of ZIP archives are decoded."""
    blobs = packers.pack_documents(table(spark, d, "documents"), "zip").withColumn("container", F.lit("zip"))
    wanted = containers.read_entries(blobs).where((F.col("size") > 1000) & F.col("path").rlike("7\\.txt$")).select("source_id", "entry_idx", "path", "method", "data_offset", "packed_size")
    return containers.zip_content(blobs, wanted).select("path", F.sha2("content", 256).alias("sha256"))


@query("gzip_members", "SELECT source, doc_id // 1280 AS part, count(*) AS docs FROM documents GROUP BY 1, 2")
def gzip_members(spark, d):
    blobs = packers.pack_documents(table(spark, d, "documents"), "tar", ".gz")
    whole = codecs.split_members(blobs).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("member", "content"))).alias("m"))
    joined = whole.select("source_id", F.lit("tar").alias("container"), F.expr("aggregate(m, cast('' as binary), (a, x) -> concat(a, x.content))").alias("content"))
    n = containers.read_entries(joined).groupBy("source_id").agg(F.count("*").alias("docs"))
    return n.select(F.split("source_id", "-")[0].alias("source"), F.split("source_id", "-")[1].cast("long").alias("part"), "docs")
