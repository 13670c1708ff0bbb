"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm import contamination, linespread


def tokenizer_file(name: str) -> str:
    """A vocabulary file's place: in the folder OXBOW_TOKENIZERS, or where the library of public tokenizers has it."""
    folder = os.environ.get("OXBOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.tokencount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.langid import documents_and_pages, fit_text_model, identify

    docs = _table(spark, sf_dir, "documents")
    rows = documents_and_pages(docs, _table(spark, sf_dir, "pages"))
    return identify(rows, fit_text_model(docs), ("origin", "doc_id", "page_id"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.remove_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.lexicon import build_lexicon, encode_decode

    docs, tokenizer = _table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    return encode_decode(docs, tokenizer, build_lexicon(docs, tokenizer))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.media import media_column

    return media_column(_table(spark, sf_dir, "documents"))


#: The key of the registered query; a user passes a secret of their own.
DEMO_KEY = "oxbow-demo-key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.surrogates import replace_personal_data

    return replace_personal_data(_table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_entities")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oxbow.llm.sharding import sharded

    out = sharded(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_near_dup": op3_near_dup,
    "op4_line_dedup": op4_line_dedup,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
}
ORACLES = {"op4_line_dedup": linespread.ORACLE, "op6_decontamination": contamination.ORACLE}
