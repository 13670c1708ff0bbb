"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm.common import stage_path
from oxbow.llm.contamination import drop_contaminated
from oxbow.llm.langid import keep_identified
from oxbow.llm.lexicon import build_lexicon, encode_decode
from oxbow.llm.linespread import remove_boilerplate
from oxbow.llm.neardup import near_duplicates
from oxbow.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  Null and empty texts and texts without a letter go;
    repeated rows and equal texts of one source go or stay together; an empty table stays empty."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines that many sites share.  Every row stays; null texts
    stay null, a text of boilerplate only becomes empty, and n_chars follows the text."""
    out = remove_boilerplate(docs)
    return out.select(*[(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id, and of these the
    one whose text has the least hash.  Documents without words and rows without an id stay;
    of repeated rows one stays.  Different texts under one id are different documents."""
    found = near_duplicates(docs).where("doc_id is not null")
    first = found.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("low")).select("low.*")
    stay = first.unionByName(found.where("class_id is null").select("doc_id", "text_hash").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))
    named = rows.join(stay, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return named.select("row.*").unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts and null ids stay; repeated rows
    and equal texts go or stay together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document; null and empty
    texts have no tokens."""
    tokenizer = tokenizer_file("word_bpe_49k.json")
    return encode_decode(docs, tokenizer, build_lexicon(docs, tokenizer), arrays=True).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Near-dedup and encoding have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
