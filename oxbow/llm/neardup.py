"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning,
exact verification on full shingle sets.

1. Documents with equal shingle sets are one class, named by its smallest id; where
   several classes have that id, by a hash of the id and the text instead.
2. Class representatives meet in the buckets of banded signatures.  Each bucket's
   members are paired with its smallest member only.
3. A pair's signatures are compared batch by batch; it is dropped as soon as the
   posterior chance that its similarity reaches the threshold is below the miss
   probability.  Survivors are verified on the full sets.
4. Buckets that still hold members of different components have their remaining
   cross-component pairs compared too, block by block inside tasks, so that no link
   between different texts depends on the choice of the smallest member.  Large
   buckets are dealt as pairs of blocks; only surviving pairs leave a task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oxbow.llm import shingles as S
from oxbow.llm.common import free_shuffles, sift, slices, stage, text_buffer, unstage
from oxbow.llm.graph import components

#: Similarity at which documents are linked, in hundredths.
THRESHOLD = 75
#: Chance, given what was compared, at which a pair is given up.
MISS = 1e-5
#: Signature places compared at a time.
BATCH = 64
#: Members of a block when a bucket is compared block against block.
BLOCK = 256


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, batch: int) -> tuple[tuple[int, int], ...]:
    """(places compared, least matches to go on) after each batch.

    With a uniform prior, m matches of k leave the similarity Beta(m+1, k-m+1); its mass
    above t equals the chance that Bin(k+1, t) is at most m.
    """
    out = []
    for k in range(batch, S.PERMUTATIONS + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append((k, m))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Indices of the row pairs whose signatures are not given up in any batch."""
    live = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    at = 0
    for k, least in least_matches(threshold, miss, BATCH):
        matches[live] += (left[live, at:k] == right[live, at:k]).sum(axis=1, dtype=np.int32)
        live = live[matches[live] >= least]
        at = k
    return live


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, offsets = text_buffer(part.column(1))
            for i, j in slices(offsets, 1 << 20):
                sets = S.shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                signs, bands = S.signatures(sets)
                keys = [S.set_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(i, j - i),
                        part.column(2).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([r.tobytes() for r in signs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * S.BANDS, pa.int32()), pa.array(bands.ravel())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "key_a", "key_b", "signature", "bands"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key_a long, key_b long, signature binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    raw, _ = text_buffer(column)
    return raw.reshape(len(column), S.PERMUTATIONS)


def _prune(threshold: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            live = survivors(_matrix(part.column(2)), _matrix(part.column(3)), threshold / 100)
            yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(live)) for k in (0, 1)], names=["a", "b"])

    return run


def _verify(threshold: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            good = []
            raw, offsets = text_buffer(part.column(3))
            for i, j in slices(offsets, 1 << 20):
                sets = S.shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, other in zip(range(i, j), sets):
                    own = held.get(a[k])
                    if own is None:
                        if len(held) >= 64:
                            held.clear()
                        one, ends = text_buffer(part.column(2).slice(k, 1))
                        own = held[a[k]] = S.shingle_sets(one, ends)[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(other) - both):
                        good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])

    return run


def _block_pairs(threshold: int):
    """Rows (bucket, i, j, node, root, block, band, signature, earlier), sorted by bucket, i, j:
    compares block i with block j.  A pair counts in the first of the bands that it shares
    only; there its bucket holds both, and none of the two as its smallest member unless that
    pair is already compared.  ``earlier`` has the bucket keys of the bands before ``band``:
    signatures are low bytes, which agree in bands that are not shared."""

    def compare(group: list) -> tuple[list, list]:
        node = np.concatenate([g[0] for g in group])
        root = np.concatenate([g[1] for g in group])
        block = np.concatenate([g[2] for g in group])
        sign = np.concatenate([g[3] for g in group])
        earlier = np.concatenate([g[7] for g in group])
        i, j = (int(group[0][k]) for k in (4, 5))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        k, least = least_matches(threshold / 100, MISS, BATCH)[0]
        out_a, out_b = [], []
        for s in range(0, len(left), 64):  # all pairs of the first batch at once, in bounded pieces
            x = left[s : s + 64]
            for t in range(0, len(right), 1024):
                y = right[t : t + 1024]
                same = (sign[x, None, :k] == sign[None, y, :k]).sum(axis=2, dtype=np.int16)
                go = (same >= least) & (root[x][:, None] != root[None, y])
                if i == j:
                    go &= node[x][:, None] < node[None, y]
                a, b = np.nonzero(go)
                first = ~(earlier[x[a]] == earlier[y[b]]).any(axis=1)
                a, b = a[first], b[first]
                live = survivors(sign[x[a]], sign[y[b]], threshold / 100)
                out_a += node[x[a[live]]].tolist()
                out_b += node[y[b[live]]].tolist()
        return out_a, out_b

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []

        def emit() -> pa.RecordBatch:
            a, b = compare(group) if len(group) > 1 or (group and len(group[0][0]) > 1) else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for part in parts:
            if not part.num_rows:
                continue
            bucket, i, j, node, root, block, band = (part.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            sign, ends, keys = _matrix(part.column(7)), np.cumsum(band), part.column(8).flatten().to_numpy()
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                key = (bucket[s], i[s], j[s])
                if key != last and group:
                    yield emit()
                    group = []
                last = key
                earlier = keys[ends[s] - band[s] : ends[e - 1]].reshape(e - s, band[s])
                group.append((node[s:e], root[s:e], block[s:e], sign[s:e], i[s], j[s], band[s], earlier))
        if group:
            yield emit()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, text_hash for every row.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and
    carriage return, with A-Z lower-cased; a document's set holds its distinct runs of
    five words, or its whole sequence if shorter.  Null, empty and blank texts have an
    empty set, linked with nothing, and no class_id.  Repeated rows fall into one class.
    Rows of one id with different texts are linked by their texts only: component_id may
    then be one id for several components, which class_id tells apart.  Rows without
    an id get their class's id and are kept only if no row of it has one.  A very long
    text is one task's work.  An empty table gives an empty table; other columns may have
    any name.
    """
    spark = docs.sparkSession
    sketch = stage(_sketch(docs, id_col, text_col), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    same = ["key_a", "key_b", "n_shingles"]
    each = full.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("low")).select(*same, "low.*")
    shared = F.count("*").over(Window.partitionBy("doc_id")) > 1
    classes = stage(each.withColumn("node", F.when(shared, -F.abs(F.xxhash64("doc_id", "text_hash"))).otherwise(F.col("doc_id"))), "classes")
    places = classes.select("node", F.col("doc_id").alias("low"), F.xxhash64("doc_id", "text_hash").alias("place"))
    firsts = stage(full.join(classes, [*same, "doc_id", "text_hash"]).select("node", "signature", "bands").dropDuplicates(["node"]), "heads")
    heads = firsts.select("node", "signature")
    bands = stage(firsts.select("node", F.posexplode("bands").alias("band", "bucket")), "bands")
    buckets = stage(bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stage(bands.join(buckets, "bucket").where("node <> head or n > 2"), "members")
    unstage(bands)
    free_shuffles(spark)
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    texts = docs.select(docs[id_col].cast("long").alias("low"), docs[text_col].alias("text")).where("low is not null").withColumn("place", F.xxhash64("low", F.xxhash64("text")))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of ``pairs`` that reach the threshold on their full sets."""
        pairs = stage(pairs, f"{name}-pruned")
        ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(places, "node"), f"{name}-ids")
        some = stage(sift(texts, ids, "place")[0].join(ids, ["place", "low"]).select("node", "text").dropDuplicates(["node"]), f"{name}-texts")
        wide = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
            some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
        )
        out = stage(wide.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold), "a long, b long"), f"{name}-links")
        unstage(pairs, some, ids)
        free_shuffles(spark)
        return out

    def pruned(pairs: DataFrame) -> DataFrame:
        signed = pairs.join(heads.select(F.col("node").alias("b"), F.col("signature").alias("sign_b")), "b").join(
            heads.select(F.col("node").alias("a"), F.col("signature").alias("sign_a")), "a"
        )
        return signed.select("a", "b", "sign_a", "sign_b").mapInArrow(_prune(threshold), "a long, b long")

    links = linked(pruned(stars), "star")
    roots = stage(components(links), "roots")
    # Buckets in which some pair apart from those with the smallest member spans components.
    rest = (
        members.where("n > 2 and node <> head")
        .join(roots, "node", "left")
        .select("bucket", "band", "n", "node", F.coalesce("root", "node").alias("root"))
    )
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        rest.join(mixed, "bucket", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .select("bucket", "band", "node", "root", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block", "band")
        .join(firsts, "node")
        .select("bucket", "i", "j", "node", "root", "block", "band", "signature", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"))
    )
    more = (
        dealt.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_block_pairs(threshold), "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    extra = linked(more, "rest")
    if not extra.isEmpty():
        roots = stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(extra)), "roots")
    rooted = classes.join(roots, "node", "left").select(*same, "doc_id", F.coalesce("root", "node").alias("class_id"))
    if classes.where("node < 0 and node <> doc_id").isEmpty():  # a root is then its component's smallest id
        named = rooted.select(*same, "class_id", F.col("class_id").alias("component"))
    else:
        named = rooted.join(rooted.groupBy("class_id").agg(F.min("doc_id").alias("component")), "class_id").select(*same, "class_id", "component")
    return (
        sketch.drop("signature")
        .join(named, same, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "class_id", "text_hash")
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", "text_hash")
    )
