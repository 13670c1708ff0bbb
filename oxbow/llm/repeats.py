"""Repeated byte passages, removed from all but the first document that has them.

For every position the longest previous factor tells how far the text from there on
repeats an earlier document.  In suffix order that factor is shared with the previous
or the next smaller position: ``longest_previous`` finds both by the common prefixes of
neighbours.  A position starts a repeat if its factor reaches ``LENGTH`` bytes; factors
are cut at that length, since no more is asked.

Suffixes are put in order in blocks.  Each window of ``LENGTH`` bytes has an anchor, its
least gram by hash, that depends on the window alone, so equal windows share an anchor
and a block holds whole anchors.  The windows of one anchor place form a piece.  Steps:

1. Texts are packed into bundles of some megabytes (one staged table).
2. Bundles send their distinct anchors, 4 bytes each, and get back one bit each: is the
   anchor in two documents at least.  Digests of whole texts go the same way and tell
   which documents are copies of an earlier one.
3. For anchors that repeat, bundles send the pieces' digests, equal ones of a bundle only
   once, and learn which pieces are whole copies of an earlier document's, and which are
   the first of their kind beside other pieces of the same anchor.
4. Only these last send their bytes, to the blocks that build suffix order, common
   prefixes and previous factors.
5. Bundles get back the repeated spans and cut them.

A block receives from one bundle each distinct item once, so a passage that a third of
all documents hold counts once a bundle, and the number of bundles is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import slices, stage, text_buffer, unstage

#: Bytes of a repeat, of an anchor's gram, and windows that one anchor can serve.
LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1
#: A bundle's bytes: at least the first, at most the second, in between a share of all bytes.
BUNDLE_LEAST, BUNDLE_MOST, BUNDLES = 4 << 20, 64 << 20, 100_000
#: Text bytes whose anchors share a block, on average.
BLOCK_BYTES = 4 << 20
#: Windows of an anchor with so many distinct pieces go one by one, by their own hash.
CROWD = 4096
#: Bytes whose grams are hashed at a time, and pieces that are ordered at a time.
CACHED, PIECES = 128 << 10, 20_000

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 1 << 32, 256).astype(np.uint32) | np.uint32(1)
_STEP = _rng.integers(1, 1 << 32, 5).astype(np.uint32) | np.uint32(1)
_NAME = _rng.integers(1, 1 << 63, GRAM // 8, np.uint64) | np.uint64(1)


def _grams(raw: np.ndarray) -> np.ndarray:
    """32-bit hash of the GRAM bytes from each position on, by doubling."""
    h = _BYTE[raw]
    for k in range(4):
        if 1 << k == GRAM - 16:
            half = h
        h = h[: len(h) - (1 << k)] * _STEP[k] + h[1 << k :]
    h = h[: len(h) - (GRAM - 16)] * _STEP[4] + half[16:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _least(x: np.ndarray) -> np.ndarray:
    """Minimum of each run of REACH values, by doubling."""
    y, n = x, 1
    while 2 * n <= REACH:
        y = np.minimum(y[:-n], y[n:])
        n *= 2
    return np.minimum(y[: len(y) - (REACH - n)], y[REACH - n :])


def _anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none
    h = _grams(raw)
    least = _least(h)  # by window start
    n = len(least)
    # Windows that start in the last LENGTH - 1 bytes of a document cross its end.
    edge = np.zeros(n + LENGTH, np.int32)
    np.add.at(edge, np.minimum(np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), n), 1)
    np.add.at(edge, np.minimum(offsets[1:], n), -1)
    valid = np.cumsum(edge[:n]) == 0
    fresh = np.empty(n, bool)  # the window before has another anchor
    fresh[0] = True
    fresh[1:] = least[1:] != least[:-1]
    fresh[1:] |= h[: n - 1] == least[:-1]
    fresh[1:] |= ~valid[:-1]
    fresh &= valid
    first = np.flatnonzero(fresh)
    if not len(first):
        return none, none, none
    ends = valid.copy()
    ends[:-1] &= fresh[1:] | ~valid[1:]
    count = np.flatnonzero(ends) + 1 - first
    at = first + np.lib.stride_tricks.sliding_window_view(h, REACH)[first].argmin(axis=1)
    return at, first, count


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, first window, windows) of each anchor that serves some window.

    A window is served by the leftmost of its least grams; windows lie within one
    document.  The windows that an anchor serves are consecutive.  An anchor's name is
    a 64-bit hash of its gram.
    """
    parts = []
    for i, j in slices(offsets, CACHED):
        s = offsets[i]
        at, first, count = _anchors(raw[s : offsets[j]], offsets[i : j + 1] - s)
        parts.append((at + s, first + s, count))
    at, first, count = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    if not len(at):
        return at, np.zeros(0, np.uint64), first, count
    gram = np.lib.stride_tricks.sliding_window_view(raw, GRAM)[at].view(np.uint64)
    name = np.zeros(len(at), np.uint64)
    for k in range(GRAM // 8):
        name = (name + gram[:, k]) * _NAME[k]
        name ^= name >> np.uint64(31)
    name *= np.uint64(0xFF51AFD7ED558CCD)
    name ^= name >> np.uint64(32)
    return at, name, first, count


def longest_previous(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order.

    ``rank`` is each suffix's place in the corpus (equal within a document) and
    ``lcp[i]`` the common prefix of suffixes i - 1 and i.  The factor is the longer of
    the common prefixes with the previous and with the next suffix of smaller rank,
    each the least ``lcp`` on the way there; both are found by doubling steps.
    """
    n = len(rank)
    best = np.zeros(n, lcp.dtype)
    if n < 2:
        return best
    for turn in (False, True):
        r = rank[::-1] if turn else rank
        c = np.concatenate((lcp[:1], lcp[:0:-1])) if turn else lcp
        low, common = [r], [c]  # least rank and least common prefix of each run of 2**k
        while 2 << len(low) <= 2 * n:
            k = 1 << (len(low) - 1)
            low.append(np.minimum(low[-1][:-k], low[-1][k:]))
            common.append(np.minimum(common[-1][:-k], common[-1][k:]))
        at, factor = np.arange(n), np.full(n, np.iinfo(lcp.dtype).max, lcp.dtype)
        for k in range(len(low) - 1, -1, -1):
            back = at - (1 << k)
            skip = back >= 0
            skip &= low[k][np.minimum(np.maximum(back, 0), len(low[k]) - 1)] >= r
            step = np.flatnonzero(skip)
            factor[step] = np.minimum(factor[step], common[k][back[step] + 1])
            at[step] = back[step]
        found = at > 0  # the suffix before ``at`` has a smaller rank
        factor = np.where(found, np.minimum(factor, c[at]), 0)
        best = np.maximum(best, factor[::-1] if turn else factor)
    return best


_HEAD = np.dtype([("id", "<i8"), ("doc", "<u4"), ("local", "<u4"), ("count", "u1"), ("shift", "u1")])


class _Bundle:
    """A bundle's documents and anchors, found the same way in every pass."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, blob: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.known = np.frombuffer(known, bool)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = zstandard.decompress(blob, max_output_size=int(self.offsets[-1]) + 1) if self.offsets[-1] else b""
        self.raw = np.frombuffer(self.bytes, np.uint8)

    def find(self) -> None:
        at, name, first, count = anchors(self.raw, self.offsets)
        doc = np.searchsorted(self.offsets, at, "right") - 1
        use = self.known[doc]
        self.at, self.name, self.first, self.count, self.doc = (x[use] for x in (at, name, first, count, doc))
        self.distinct, self.place = np.unique(self.name, return_inverse=True)

    def text(self, d: int) -> np.ndarray:
        return self.raw[self.offsets[d] : self.offsets[d + 1]]

    def copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents long enough to hold a repeat, the distinct digests of their texts, the
        place of each document's among these, and the least id of each."""
        docs = np.flatnonzero(self.known & (self.sizes >= LENGTH))
        o = self.offsets
        digest = _digests(self.bytes, o[docs], o[docs + 1])
        distinct, place = _distinct(digest)
        return docs, distinct, place, _least_of(self.ids[docs], place, len(distinct))

    def pieces(self, answers: list) -> _Pieces:
        """The pieces of repeated anchors outside copied documents, from the first answers."""
        self.find()
        docs, digest, place, least = self.copies()
        twice, copied = np.zeros(len(self.distinct), bool), np.zeros(len(digest), bool)
        for a in answers or ():
            marked = twice if a["bucket"] >= 0 else copied
            marked[a["from"] : a["to"]] = np.unpackbits(np.frombuffer(a["body"], np.uint8), count=a["to"] - a["from"]).astype(bool)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[docs] = copied[place] | (self.ids[docs] > least[place])
        use = np.flatnonzero(twice[self.place] & ~self.copy[self.doc]) if len(self.doc) else np.zeros(0, np.int64)
        return _Pieces(self, self.doc[use], self.first[use], self.count[use], self.at[use] - self.first[use], self.name[use])


def _digests(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests as pairs of numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), np.uint64).reshape(-1, 2)


def _distinct(pairs: np.ndarray, *major: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, in order of ``major`` if given, and each row's place among them."""
    keys = [pairs[:, 1], pairs[:, 0], *major]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            ranked = k[order]
            new[1:] |= ranked[1:] != ranked[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return pairs[order[new]], place


def _least_of(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, place, values)
    return out


class _Pieces:
    """Stretches of a bundle's bytes: the windows that an anchor place serves."""

    def __init__(self, bundle: _Bundle, doc, first, count, shift, name):
        self.bundle, self.doc, self.first, self.count, self.shift, self.name = bundle, doc, first, count, shift, name

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, x: np.ndarray) -> _Pieces:
        return _Pieces(self.bundle, *(c[x] for c in (self.doc, self.first, self.count, self.shift, self.name)))

    def ends(self) -> np.ndarray:
        return self.first + self.count + (LENGTH - 1)

    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests and names of the distinct pieces, by name; each piece's place among
        them; and the least id that holds each."""
        digest, place = _distinct(_digests(self.bundle.bytes, self.first, self.ends()), self.name)
        name = np.empty(len(digest), np.uint64)
        name[place] = self.name
        return digest, name, place, _least_of(self.bundle.ids[self.doc], place, len(digest))

    def windows(self) -> _Pieces:
        """Each window as a piece of its own, by its own hash."""
        which = np.repeat(np.arange(len(self)), self.count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        first = self.first[which] + step
        own = _digests(self.bundle.bytes, first, first + LENGTH)[:, 0]
        return _Pieces(self.bundle, self.doc[which], first, np.ones_like(which), self.shift[which] - step, own)

    def spans(self) -> np.ndarray:
        """(document, from, to) of what the pieces cover; neighbours are joined."""
        if not len(self):
            return np.zeros((0, 3), np.int64)
        cut = np.flatnonzero((np.diff(self.doc) != 0) | (self.first[1:] != self.first[:-1] + self.count[:-1])) + 1
        begin, last = np.concatenate(([0], cut)), np.append(cut, len(self)) - 1
        doc = self.doc[begin]
        base = self.bundle.offsets[doc]
        return np.stack([doc, self.first[begin] - base, self.ends()[last] - base], axis=1).astype(np.int64)

    def message(self) -> tuple[bytes, bytes]:
        head = np.empty(len(self), _HEAD)
        local = self.first - self.bundle.offsets[self.doc]
        for name, c in (("id", self.bundle.ids[self.doc]), ("doc", self.doc), ("local", local), ("count", self.count), ("shift", self.shift)):
            head[name] = c
        text = self.bundle.bytes
        return b"".join([text[s:e] for s, e in zip(self.first.tolist(), self.ends().tolist())]), head.tobytes()


def _bundles(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        held: list[list] = [[], [], [], []]

        def out() -> pa.RecordBatch:
            nonlocal k
            ids, known, sizes, texts = held
            size = np.concatenate(sizes)
            cells = [np.concatenate(ids).tobytes(), np.concatenate(known).tobytes(), size.tobytes(), pack(b"".join(texts))]
            done = pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["bundle", "ids", "known", "sizes", "blob"])
            k += 1
            for h in held:
                h.clear()
            return done

        size = 0
        for part in parts:
            raw, offsets = text_buffer(part.column(1))
            known = np.asarray(part.column(0).is_valid())
            ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(offsets, limit // 4):
                for h, x in zip(held, (ids[i:j], known[i:j], np.diff(offsets[i : j + 1]), raw[offsets[i] : offsets[j]].tobytes())):
                    h.append(x)
                size += int(offsets[j] - offsets[i])
                if size >= limit:
                    yield out()
                    size = 0
        if held[0]:
            yield out()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(run, "bundle long, ids binary, known binary, sizes binary, blob binary")


#: ``from`` and ``to`` number a message's items within its bundle.
_MESSAGE = "bucket long, bundle long, `from` long, `to` long, body binary, flags binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cells = zip(*rows) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=["bucket", "bundle", "from", "to", "body", "flags"])


def _bucket_of(names: np.ndarray, n: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _stretches(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs in an ordered array."""
    cut = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    if len(bucket):
        for s, e in zip([0, *cut], [*cut, len(bucket)]):
            yield int(bucket[s]), s, e


def _each_bundle(part: pa.RecordBatch) -> Iterator[tuple[int, _Bundle, list]]:
    for r in range(part.num_rows):
        cells = [part.column(c)[r].as_py() for c in range(part.num_columns)]
        yield cells[0], _Bundle(*cells[1:5]), cells[5:]


def _send_anchors(n_buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, b, _ in _each_bundle(part):
                b.find()
                low, high = np.full(len(b.distinct), len(b.ids)), np.full(len(b.distinct), -1)
                np.minimum.at(low, b.place, b.doc)
                np.maximum.at(high, b.place, b.doc)
                shared, short = low < high, b.distinct.astype(np.uint32)
                rows = [(t, k, s, e, short[s:e].tobytes(), np.packbits(shared[s:e]).tobytes()) for t, s, e in _stretches(_bucket_of(b.distinct, n_buckets))]
                _, digest, _, least = b.copies()
                to = _bucket_of(digest[:, 0], n_buckets)
                rows += [(-1 - t, k, s, e, digest[s:e].tobytes(), least[s:e].tobytes()) for t, s, e in _stretches(to)]
                yield _rows(rows)

    return run


def _by_bucket(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole buckets, as Arrow tables, from batches sorted by bucket."""
    last, held = None, []
    for part in parts:
        for t, s, e in _stretches(part.column(0).to_numpy(zero_copy_only=False)):
            if t != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = t
            held.append(part.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers in all cells of a binary column, one after another."""
    return text_buffer(table.column(name))[0].view(kind)


def _replies(table: pa.Table, *marks: np.ndarray) -> pa.RecordBatch:
    """One bit an item and mark back to each message that has a bit set."""
    bucket, bundle, start, stop = (table.column(c).to_numpy().tolist() for c in ("bucket", "bundle", "from", "to"))
    rows, at = [], 0
    for t, k, s, e in zip(bucket, bundle, start, stop):
        bits = [m[at : at + e - s] for m in marks]
        at += e - s
        if any(x.any() for x in bits):
            rows.append((t, k, s, e, *(np.packbits(x).tobytes() for x in bits), *([None] * (2 - len(bits)))))
    return _rows(rows)


def _answer_anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor: is it in two documents; for each text: does an earlier document have it."""
    for bucket, table in _by_bucket(parts):
        if bucket >= 0:
            names = _flat(table, "body", np.uint32)
            flags = table.column("flags").to_pylist()
            counts = (table.column("to").to_numpy() - table.column("from").to_numpy()).tolist()
            shared = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=c) for f, c in zip(flags, counts)])
            order = np.argsort(names, kind="stable")
            ranked = names[order]
            starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            times = np.diff(np.append(starts, len(names)))
            twice = np.empty(len(names), bool)
            twice[order] = np.repeat((times > 1) | np.logical_or.reduceat(shared[order] > 0, starts), times)
            yield _replies(table, twice)
        else:
            digest, ids = _flat(table, "body", np.uint64).reshape(-1, 2), _flat(table, "flags", np.int64)
            distinct, place = _distinct(digest)
            yield _replies(table, _least_of(ids, place, len(distinct))[place] < ids)


_PIECE = np.dtype([("id", "<i8"), ("name", "<u4")])


def _send_pieces(n_buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, b, (bits,) in _each_bundle(part):
                digest, name, _, least = b.pieces(bits).kinds()
                tail = np.empty(len(name), _PIECE)
                tail["id"], tail["name"] = least, name.astype(np.uint32)
                yield _rows([(t, k, s, e, digest[s:e].tobytes(), tail[s:e].tobytes()) for t, s, e in _stretches(_bucket_of(name, n_buckets))])

    return run


def _answer_pieces(crowd: int):
    """Two marks for each piece: 1 0 an earlier document has it whole; 0 1 it is the first
    of its kind beside others of its anchor; 1 1 the same, beside ``crowd`` kinds or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _by_bucket(parts):
            digest, tail = _flat(table, "body", np.uint64).reshape(-1, 2), _flat(table, "flags", _PIECE)
            distinct, place = _distinct(digest, tail["name"])
            later = _least_of(tail["id"], place, len(distinct))[place] < tail["id"]
            name = np.empty(len(distinct), np.uint32)
            name[place] = tail["name"]
            starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            kinds = np.diff(np.append(starts, len(name)))
            beside = np.repeat(kinds, kinds)[place]
            yield _replies(table, later | (beside >= crowd), ~later & (beside > 1))

    return run


def _send_windows(n_buckets: int):
    """Bytes of pieces that stand beside others; what is settled goes out as spans, bucket below 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, b, (bits, marks) in _each_bundle(part):
                pieces = b.pieces(bits)
                digest, _, place, least = pieces.kinds()
                one, two = np.zeros((2, len(digest)), bool)
                for a in marks or ():
                    for to, cell in ((one, "body"), (two, "flags")):
                        to[a["from"] : a["to"]] = np.unpackbits(np.frombuffer(a[cell], np.uint8), count=a["to"] - a["from"]).astype(bool)
                own = b.ids[pieces.doc] == least[place] if len(pieces) else np.zeros(0, bool)
                opened, crowd = two[place] & own, (one & two)[place] & own
                whole = np.flatnonzero(b.copy)
                settled = np.concatenate([
                    np.stack([whole, np.zeros_like(whole), b.sizes[whole]], axis=1),
                    pieces.take(np.flatnonzero((one & ~two)[place] | ~own)).spans(),
                ])
                rows = [(-1 - k % n_buckets, k, 0, 0, settled.astype(np.int64).tobytes(), None)] if len(settled) else []
                calm, single = pieces.take(np.flatnonzero(opened & ~crowd)), pieces.take(np.flatnonzero(crowd)).windows()
                for some in (calm, single):
                    to = _bucket_of(some.name, n_buckets)
                    order = np.argsort(to, kind="stable")
                    rows += [(t, k, 0, e - s, *some.take(order[s:e]).message()) for t, s, e in _stretches(to[order])]
                yield _rows(rows)

    return run


def _cuts(gram: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """``order`` in batches of some PIECES that end between two anchors."""
    ranked = gram[order]
    edges = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    if not len(edges):
        return [order]
    return np.split(order, np.unique(edges[np.minimum(np.searchsorted(edges, np.arange(PIECES, len(order), PIECES)), len(edges) - 1)]))


def repeated_windows(blob: np.ndarray, at: np.ndarray, shift: np.ndarray, count: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece, window) of the windows whose longest previous factor reaches LENGTH.

    Pieces have their anchor at ``at`` of ``blob``, ``shift`` bytes after their first
    byte, and ``count`` windows.  The suffixes from the anchors on are sorted once;
    each byte further to the left, the order is induced by a stable sort of that byte.
    """
    pad = np.zeros(LENGTH, np.uint8)
    blob = np.concatenate((pad, blob, pad))
    at = at + LENGTH
    rows = np.lib.stride_tricks.sliding_window_view(blob, LENGTH)
    order = np.argsort(rows[at].view(f"S{LENGTH}").ravel(), kind="stable")
    for l in range(int(shift.max(initial=0)) + 1):  # noqa: E741
        if l:
            order = order[np.argsort(blob[at[order] - l], kind="stable")]
        x = order[(shift[order] >= l) & (shift[order] - l < count[order])]
        if len(x) < 2:
            continue
        windows = rows[at[x] - l]
        same = windows[1:] == windows[:-1]
        lcp = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)).astype(np.int32)
        lcp = np.concatenate(([0], lcp))
        # A factor of LENGTH needs a neighbour that shares as much.
        near = lcp >= LENGTH
        near[:-1] |= near[1:].copy()
        x, lcp = x[near], lcp[near]
        hit = x[longest_previous(rank[x], lcp) >= LENGTH]
        yield hit, shift[hit] - l


def _answer_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, table in _by_bucket(parts):
        if bucket < 0:
            yield from table.to_batches()
            continue
        head, blob = _flat(table, "flags", _HEAD), _flat(table, "body", np.uint8)
        of = table.column("bundle").to_numpy()
        bundle = np.repeat(np.arange(len(of)), table.column("to").to_numpy())
        ids, doc, local, count, shift = (head[c].astype(np.int64) for c in _HEAD.names)
        at = np.concatenate(([0], np.cumsum(count + LENGTH - 1)[:-1])) + shift
        gram = np.lib.stride_tricks.sliding_window_view(blob, 8)[at].view(np.uint64).ravel()
        found = []
        for some in _cuts(gram, np.argsort(gram, kind="stable")):
            for hit, step in _compact(blob, at, shift, count, ids, some):
                x = some[hit]
                found.append(np.stack([bundle[x], doc[x], local[x] + step], axis=1))
        rows = []
        if found:
            found = np.concatenate(found)
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            for r, s, e in _stretches(found[:, 0]):
                rows.append((bucket, int(of[r]), 0, 0, _runs(found[s:e, 1], found[s:e, 2]).tobytes(), None))
        yield _rows(rows)


def _compact(blob, at, shift, count, ids, some) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``repeated_windows`` over the bytes of some pieces only."""
    size = count[some] + LENGTH - 1
    end = np.cumsum(size)
    take = np.arange(int(end[-1])) + np.repeat(at[some] - shift[some] - (end - size), size)
    return repeated_windows(blob[take], end - size + shift[some], shift[some], count[some], ids[some])


def _runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(document, from, to) of the spans that ordered windows with consecutive starts cover."""
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) > 1)) + 1
    first, last = np.concatenate(([0], cut)), np.append(cut, len(doc)) - 1
    return np.stack([doc[first], start[first], start[last] + LENGTH], axis=1).astype(np.int64)


def _cut(keep_text: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, b, (bodies,) in _each_bundle(part):
                edge = np.zeros(len(b.raw) + 1, np.int32)
                for body in bodies or ():
                    spans = np.frombuffer(body, np.int64).reshape(-1, 3)
                    base = b.offsets[spans[:, 0]]
                    np.add.at(edge, base + spans[:, 1], 1)
                    np.add.at(edge, base + spans[:, 2], -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = (total[b.offsets[1:]] - total[b.offsets[:-1]]).tolist()
                out: list[list] = [[] for _ in range(6)]
                for d, n in enumerate(removed):
                    text, mask = b.text(d), gone[b.offsets[d] : b.offsets[d + 1]]
                    kept = (text[~mask] if n else text).tobytes()
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                    for held, x in zip(out, (int(b.ids[d]) if b.known[d] else None, len(text), n, runs, hashlib.sha256(kept).hexdigest(), kept)):
                        held.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                m = 6 if keep_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out[:m], kinds)], names=names[:m])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
    bundle_least: int = BUNDLE_LEAST, block_bytes: int = BLOCK_BYTES, crowd: int = CROWD,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``keep_text``
    also ``kept``, the remaining bytes.

    A byte goes if some 50 bytes that cover it also begin in a document of smaller id.
    Null text counts as empty.  Rows of one id (repeated rows among them) do not touch
    each other; a row without an id is neither earlier nor later than any other, so it
    stays whole.  Ties arise only between equal ids.  A very long text is a bundle of its
    own, read whole by one task.  An empty table gives an empty table.  Only the two named
    columns are read, so others may have any name.  ``bundle_least``, ``block_bytes`` and
    ``crowd`` change the work's division, never a result.
    """
    total = docs.select(F.sum(F.octet_length(docs[text_col].cast("binary")).cast("long"))).first()[0] or 0
    bundles = stage(_bundles(docs, id_col, text_col, min(BUNDLE_MOST, max(bundle_least, total // BUNDLES))), "bundles")
    n = max(1, -(-total // block_bytes))

    def meet(sent: DataFrame, answer, name: str) -> DataFrame:
        # Blocks share the session's shuffle partitions and are read one after another.
        return stage(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, _MESSAGE), name)

    def told(cells: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        each = answers.groupBy("bundle").agg(F.collect_list(F.struct("bucket", "from", "to", "body", "flags")).alias(name))
        return cells.join(each, "bundle", "left")

    bits = meet(bundles.mapInArrow(_send_anchors(n), _MESSAGE), _answer_anchors, "anchor-bits")
    known = told(bundles, bits, "bits")
    marks = meet(known.mapInArrow(_send_pieces(n), _MESSAGE), _answer_pieces(crowd), "piece-marks")
    spans = meet(told(known, marks, "marks").mapInArrow(_send_windows(n), _MESSAGE), _answer_windows, "spans")
    unstage(bits, marks)
    bodies = spans.groupBy("bundle").agg(F.collect_list("body").alias("bodies"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return bundles.join(bodies, "bundle", "left").mapInArrow(_cut(keep_text), schema + (", kept binary" if keep_text else ""))
