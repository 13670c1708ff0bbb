"""Cross-site boilerplate lines, by distinct-site spread.  DataFrame functions only.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation.
Lines whose estimate lies near the threshold get an exact distinct count; the
others are decided by the sketch, whose error there is far smaller than the gap.

Spread alone does not tell boilerplate from copies: a document that ten sites copied has
all its lines on ten sites.  So spread is taken twice.  Lines on enough sites are
candidates; texts that are candidates for more than half of their bytes look like copies
and bear no witness; a candidate is boilerplate if the other texts have it on enough
sites.  Boilerplate is then cut from every document, however much of it that takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import sift, stage

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 10
#: Shorter lines (in characters, without spaces at the ends) are never boilerplate.
MIN_CHARS = 16
#: A text of which candidates are more than this share of bytes is no witness to boilerplate.
COPY_SHARE = 0.5
#: Registers of a sketch as a power of two, and the standard errors that count as near.
LG_K, ERRORS = 10, 5


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """line_key of the lines on at least ``min_sites`` sites; ``lines`` has line_key and site."""
    near = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    sketched = stage(
        lines.groupBy("line_key")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
        .where(F.col("sites") >= min_sites - near),
        "line-spread",
    )
    unsure = sketched.where(F.col("sites") <= min_sites + near).select("line_key")
    exact = (
        lines.join(unsure, "line_key", "left_semi")
        .groupBy("line_key", "site").agg(F.lit(1).alias("one"))
        .groupBy("line_key").count()
        .where(F.col("count") >= min_sites)
        .select("line_key")
    )
    return stage(sketched.where(F.col("sites") > min_sites + near).select("line_key").unionByName(exact), "widespread")


def boilerplate_lines(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, copy_share: float = COPY_SHARE
) -> DataFrame:
    """text_key, line_key of each boilerplate line of each text, staged.  Rows without a
    site count for one unnamed site; null texts have no lines."""
    site = F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site")
    text = docs[text_col]

    def long_lines(*with_them: Column) -> DataFrame:
        rows = docs.select(*with_them, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.length(F.trim("line")) >= min_chars)
        return rows.withColumn("line_key", _key(F.col("line")))

    spread = widespread(stage(long_lines(site).select("line_key", "site"), "line-sites"), min_sites)
    held = stage(
        long_lines(site, F.xxhash64(text).alias("text_key"), F.octet_length(text).alias("total"))
        .join(spread, "line_key")
        .select("text_key", "line_key", "site", "pos", "total", F.octet_length("line").alias("size"))
        .distinct(),  # of copies on one site, one
        "line-uses",
    )
    copies = (
        held.groupBy("text_key", "pos").agg(F.max("size").alias("size"), F.max("total").alias("total"))
        .groupBy("text_key").agg(F.sum("size").alias("size"), F.max("total").alias("total"))
        .where(F.col("size") > F.col("total") * F.lit(copy_share))
        .select("text_key")
    )
    proven = widespread(stage(held.select("text_key", "line_key", "site").distinct().join(copies, "text_key", "left_anti").select("line_key", "site"), "line-witnesses"), min_sites)
    return stage(held.select("text_key", "line_key").distinct().join(proven, "line_key"), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, copy_share: float = COPY_SHARE
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the texts, plus n_lines and n_removed.

    Null text stays null with no lines; an empty text has one empty line; a text of
    boilerplate only becomes empty.  Repeated rows and equal texts are treated alike, so
    there are no ties.  A very long text is split by one task.  Other columns pass through
    under any name (they travel in one struct); an empty table gives an empty table.
    """
    text = docs[text_col]
    hits = stage(boilerplate_lines(docs, text_col, site_col, min_sites, min_chars, copy_share).groupBy("text_key").agg(F.collect_set("line_key").alias("cut")), "line-cuts")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    perhaps, others = sift(rows, hits, "text_key")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~((F.length(F.trim(x)) >= min_chars) & F.array_contains(F.col("cut"), _key(x))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))

    def shown(text: Column, removed: Column) -> list[Column]:
        return [
            *[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns],
            n_lines.cast("long").alias("n_lines"),
            removed.cast("long").alias("n_removed"),
        ]

    # The cuts grow with the input: they are never broadcast, so that the plan is the same at every size.
    met = perhaps.join(hits.hint("merge"), "text_key", "left").withColumn("kept", F.when(F.col("cut").isNotNull(), kept))
    cut = F.col("kept").isNotNull()
    touched = met.select(*shown(F.when(cut, F.array_join("kept", "\n")).otherwise(F.col("text")), F.when(cut, n_lines - F.size("kept")).otherwise(0)))
    return touched.union(others.select(*shown(F.col("text"), F.lit(0))))


ORACLE = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS source, text, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
u AS (SELECT *, CASE WHEN length(trim(line, ' ')) >= {MIN_CHARS} THEN trim(line, ' ') END AS k FROM l),
c AS (SELECT k FROM u WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
y AS (SELECT DISTINCT text FROM (SELECT doc_id, text, sum(octet_length(encode(line))) AS g FROM u SEMI JOIN c USING (k) GROUP BY 1, 2) WHERE g > {COPY_SHARE} * octet_length(encode(text))),
b AS (SELECT k FROM u SEMI JOIN c USING (k) WHERE text NOT IN (SELECT text FROM y) GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, coalesce(string_agg(u.line, chr(10) ORDER BY i) FILTER (b.k IS NULL), '') AS text, count(*) AS n_lines, count(b.k) AS n_removed
FROM u LEFT JOIN b ON u.k = b.k GROUP BY doc_id, u.text
"""
