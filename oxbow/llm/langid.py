"""Language of texts by Bayesian fusion of evidence.

Text likelihoods come from hashed byte n-grams; a declared markup language counts by
how reliable such declarations prove to be; the address suffix and the host give a
prior that is smoothed from all pages to the suffix to the host.  Reliabilities and
priors are sums of text posteriors, computed by grouped aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.llm.common import slices, stage, text_buffer

#: Labelled texts that the text model is fitted on, in equal parts by label, and their longest
#: in bytes; a label has at least so many, however many labels there are.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 200_000
LABEL_ROWS = 50
GRAM, SLOTS = 4, 1 << 16
#: n-grams overlap; this scales their joint evidence to that of independent ones.
TEMPER = 1 / GRAM
#: Pseudo-rows of the suffix in a host's prior, and of all rows in a suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
#: Share of n-grams of a language that its sample has not shown.
UNSEEN = 0.3
#: n-grams that are looked up at once, so that a text of any length needs little memory.
PIECE = 1 << 16
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.005
#: A text is rejected if it is this surely in none of the languages, or has no letters.
REJECT = 0.9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def _slots(raw: np.ndarray) -> np.ndarray:
    """Slot of the four bytes from each position on."""
    x = _LOWER[raw].astype(np.uint32)
    h = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    h *= np.uint32(2654435761)
    return h >> np.uint32(16)


@dataclass
class TextModel:
    """log-probabilities of the slots by language; the last column is that of no language."""

    langs: list[str]
    table: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tempered log-likelihood of each text under each language."""
        n = len(offsets) - 1
        out = np.zeros((n, self.table.shape[1]))
        for k in range(n):
            last = max(offsets[k], offsets[k + 1] - GRAM + 1)
            for a in range(offsets[k], last, PIECE):
                slot = _slots(raw[a : min(a + PIECE, last) + GRAM - 1])
                out[k] += self.table[slot].sum(axis=0, dtype=np.float64)
        return out * TEMPER


def label_sample(labelled: DataFrame, text_col: str, lang_col: str, sample_rows: int) -> tuple[list[str], DataFrame]:
    """All labels, sorted, and (lang, text) of at most max(LABEL_ROWS, sample_rows / labels)
    distinct texts of each: those with the least hashes.  Of longer texts, the beginning.
    """
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    hashed = stage(rows.select("lang", "h").distinct(), "label-hashes")
    sizes = {r["lang"]: r["count"] for r in hashed.groupBy("lang").count().collect()}  # a row for each label
    most = max(LABEL_ROWS, sample_rows // max(1, len(sizes)))
    # Hashes are spread evenly: twice as many as are wanted lie below the bound, and are ranked.
    highest = [min((1 << 63) - 1, (2 * most << 64) // n - (1 << 63)) for n in sizes.values()]
    bounds = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array(sizes, pa.string()), "bound": pa.array(highest, pa.int64())}))
    low = hashed.join(F.broadcast(bounds), "lang").where("h <= bound")
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = stage(ranked.where(F.col("rank") <= most).select("lang", "h"), "label-sample")
    short = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES // 4))
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first(short).alias("text"))
    return sorted(sizes), found.select("lang", "text")


def fit_text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit on the ``label_sample`` of the rows that have a text and a label; every label
    among them is a language of the model."""
    langs, texts = label_sample(labelled, text_col, lang_col, sample_rows)
    sample = texts.toArrow()
    names = sample.column("lang").to_pylist()
    langs = langs or [UNKNOWN + "-none"]
    counts = np.full((len(langs), SLOTS), 0.02)
    for text, lang in zip(sample.column("text").to_pylist(), names):
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) >= GRAM:
            counts[langs.index(lang)] += np.bincount(_slots(raw), minlength=SLOTS)
    logs = np.log((1 - UNSEEN) * counts / counts.sum(axis=1, keepdims=True) + UNSEEN / SLOTS)
    return TextModel(langs, np.vstack([logs, np.full(SLOTS, -np.log(SLOTS))]).T.astype(np.float32).copy())


def evidence_of_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> list[Column]:
    """text, declared, host and suffix columns of raw pages."""
    html, url = pages[html_col], pages[url_col]
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return [
        F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit("")).alias("declared"),
        host.alias("host"),
        F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).alias("suffix"),
    ]


def identify(rows: DataFrame, model: TextModel, keys: tuple[str, ...]) -> DataFrame:
    """``keys`` of each row with lang, posterior, kept.

    ``rows`` has text, declared, host, suffix (strings); each may be null and then
    weighs nothing.  Texts without a letter have lang ``und``, posterior 1 and are
    rejected; others are rejected only where ``und`` reaches REJECT.  Ties go to the
    language first in the alphabet.  A row's own text is left out of its priors.
    """
    langs = [*model.langs, UNKNOWN]
    n = len(langs)
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((model.langs, model.table))  # SLOTS * languages floats
    start = np.array([(1 - UNKNOWN_PRIOR) / (n - 1)] * (n - 1) + [UNKNOWN_PRIOR])

    def by_text(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_model = TextModel(*shared.value)
        for part in parts:
            raw, offsets = text_buffer(part.column(0))
            for i, j in slices(offsets):
                logs = text_model.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                logs -= logs.max(axis=1, keepdims=True)
                lettered = part.column(4).slice(i, j - i)
                first = _softmax(logs + np.log(start)) * np.asarray(lettered)[:, None]
                rest = [part.column(c).slice(i, j - i) for c in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, _lists(logs), _lists(first)], names=names)
        pa.default_memory_pool().release_unused()

    picked = rows.select("text", "declared", "host", "suffix", F.coalesce(rows["text"].rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.struct(*[rows[k] for k in keys]).alias("key"))
    list_ = T.ArrayType(T.DoubleType())
    schema = T.StructType([*picked.schema.fields[1:], T.StructField("logs", list_), T.StructField("first", list_)])
    names = [f.name for f in schema.fields]
    scored = stage(picked.mapInArrow(by_text, schema), "language-scores")

    held = scored.where("lettered")
    sums = F.array(*[F.sum(F.col("first")[k]) for k in range(n)]).alias("sums")
    known = F.when(F.col("declared").isin(model.langs), F.col("declared")).when(F.col("declared").isNotNull(), "other")
    # A row for each language, two more at most: (declared, sums).
    said = {r["d"]: np.array(r["sums"], float) for r in held.groupBy(known.alias("d")).agg(sums).collect()}
    overall = sum(said.values(), np.zeros(n)) + 10 * start
    overall /= overall.sum()
    told = [*model.langs, "other"]
    counts = np.array([said.get(d, np.zeros(n)) for d in told]) + 0.5
    reliability = np.log(counts / counts.sum(axis=0))
    suffixes = stage(held.where("suffix is not null").groupBy("suffix").agg(sums), "suffixes").withColumnRenamed("sums", "of_suffix")
    hosts = stage(held.where("host is not null").groupBy("host").agg(sums), "hosts").withColumnRenamed("sums", "of_host")
    joined = scored.join(suffixes, "suffix", "left").join(hosts, "host", "left").select("key", "lettered", "declared", "logs", "first", "of_suffix", "of_host")

    def fused(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {d: k for k, d in enumerate(told)}
        for part in parts:
            m = part.num_rows
            if not m:
                continue
            logs, first = _rows_of(part.column(3), n), _rows_of(part.column(4), n)
            prior = np.broadcast_to(overall, (m, n))
            for c, weight in ((5, SUFFIX_WEIGHT), (6, HOST_WEIGHT)):
                # the row's own share is left out; where there is no suffix or host, nothing is added
                has = np.asarray(part.column(c).is_valid())[:, None]
                own = np.where(has, np.maximum(_rows_of(part.column(c), n) - first, 0), 0)
                prior = (own + weight * prior) / (own.sum(axis=1, keepdims=True) + weight)
            logs = logs + np.log(prior)
            said_ = part.column(2).to_pylist()
            at = np.array([-1 if d is None else place.get(d, len(told) - 1) for d in said_])
            logs[at >= 0] += reliability[at[at >= 0]]
            post = _softmax(logs)
            lettered = np.asarray(part.column(1))
            best = np.where(lettered, post.argmax(axis=1), n - 1)
            sure = np.where(lettered, post.max(axis=1), 1.0)
            kept = lettered & (post[:, n - 1] < REJECT)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([langs[k] for k in best]), pa.array(sure.round(6)), pa.array(kept)], names=["key", "lang", "posterior", "kept"])

    final = T.StructType([picked.schema["key"], T.StructField("lang", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return joined.mapInArrow(fused, final).select(*[F.col("key").getField(k).alias(k) for k in keys], "lang", "posterior", "kept")


def _softmax(logs: np.ndarray) -> np.ndarray:
    x = np.exp(logs - logs.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _rows_of(column: pa.ListArray, n: int) -> np.ndarray:
    """Lists of n numbers as a matrix; null lists are zeros."""
    out = np.zeros((len(column), n))
    out[np.asarray(column.is_valid())] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def documents_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows for ``identify``: documents, whose source is the host, and raw pages."""
    none = F.lit(None).cast("string")
    a = docs.select(F.lit("documents").alias("origin"), docs["doc_id"].cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), docs["text"].alias("text"), none.alias("declared"), docs["source"].cast("string").alias("host"), none.alias("suffix"))
    b = pages.select(F.lit("pages").alias("origin"), F.lit(None).cast("long").alias("doc_id"), pages["page_id"].cast("long").alias("page_id"), *evidence_of_pages(pages))
    return a.unionByName(b)


def keep_identified(docs: DataFrame, text_col: str = "text", host_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told; all columns as they are."""
    model = fit_text_model(docs, text_col, lang_col)
    none = F.lit(None).cast("string")
    rows = docs.select(docs[text_col].alias("text"), none.alias("declared"), docs[host_col].cast("string").alias("host"), none.alias("suffix"), F.xxhash64(docs[text_col]).alias("text_key"), F.xxhash64(docs[host_col].cast("string")).alias("host_key"))
    bad = stage(identify(rows, model, ("text_key", "host_key")).where(~F.col("kept")).select("text_key", "host_key").distinct(), "rejected")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs[text_col]).alias("text_key"), F.xxhash64(docs[host_col].cast("string")).alias("host_key"))
    return whole.join(bad, ["text_key", "host_key"], "left_anti").select("row.*")
