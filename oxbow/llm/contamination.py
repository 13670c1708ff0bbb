"""Benchmark items inside long documents, by size-partitioned MinHash containment.
DataFrame functions only.

Items are partitioned by size.  Each partition's upper size fixes how many minimum
hashes (the bottom of one permutation) an item keeps: so many that an item of that
size cannot reach the wanted containment in a document without sharing one of them.
Every document is probed with all its shingles, since no fixed-size signature of a
document holds recall when it is a thousand times longer than the item.  Candidates
are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import sift, stage

SHINGLE = 5
CONTAINMENT = 0.75


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of ``k`` words; of the whole sequence where it is shorter.

    The words are bound to a lambda's variable, so a row's text is split once."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        return (
            F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k)))))
            .when(n > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.transform(F.array(words_of(text)), runs)[0]


def item_sketches(items: DataFrame, item_col: str, text_col: str, containment: float) -> DataFrame:
    """item_id, shingles, n, sketch of every item that has words."""
    sets = (
        items.select(items[item_col].alias("item_id"), F.array_distinct(shingles_of(items[text_col])).alias("shingles"))
        .withColumn("n", F.size("shingles"))
        .where(F.col("n") > 0)
    )
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))  # sizes in (u/2, u] share a partition
    keep = (F.floor(upper * (1 - containment) + 1e-9) + 1).cast("int")
    by_rank = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(F.lit(11), s).alias("rank"), s.alias("s"))))
    return sets.select("item_id", "shingles", "n", F.slice(F.transform(by_rank, lambda x: x["s"]), F.lit(1), keep).alias("sketch"))


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared: one row per document and item
    with ``n_shared >= containment * n_shingles``; also text_key, the text's hash.

    Null or empty texts and items match nothing.  Items (documents) of fewer than five
    words have their whole sequence as one shingle, so they match only documents of the
    same few words.  Repeated rows and null ids give a row each.  Only the named
    columns are read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    sketches = stage(item_sketches(items, item_col, item_text_col, containment).withColumn("item_key", F.xxhash64("item_id", "shingles")).dropDuplicates(["item_id", "item_key"]), "items")
    probes = stage(sketches.select(F.explode("sketch").alias("shingle"), "item_key").distinct(), "probes")
    candidates = stage(
        rows.select("text_key", F.explode(shingles_of(F.col("text"))).alias("shingle"))
        .join(probes, "shingle")
        .groupBy("text_key")
        .agg(F.collect_set("item_key").alias("item_keys")),
        "candidates",
    )
    sets = sift(rows, candidates, "text_key")[0].join(candidates, "text_key").select(
        "doc_id", "text_key", "item_keys", F.array_distinct(shingles_of(F.col("text"))).alias("doc_shingles")
    )
    pairs = sets.select("doc_id", "text_key", "doc_shingles", F.explode("item_keys").alias("item_key")).join(sketches.drop("sketch"), "item_key")
    return pairs.select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("doc_shingles", "shingles")).cast("long").alias("n_shared"), "text_key",
    ).where(F.col("n_shared") >= F.col("n_shingles") * F.lit(containment))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; null texts stay."""
    text_col = options.get("text_col", "text")
    bad = stage(find_contaminated(docs, items, **options).select("text_key").distinct(), "contaminated")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs[text_col]).alias("text_key"))
    perhaps, others = sift(rows, bad, "text_key")
    return perhaps.join(bad, "text_key", "left_anti").select("row.*").union(others.select("row.*"))


ORACLE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM bw),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1)
SELECT ds.doc_id, bs.item_id, any_value(n.n_shingles) AS n_shingles, count(*) AS n_shared FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY 1, 2 HAVING count(*) >= {CONTAINMENT} * any_value(n.n_shingles)
"""
