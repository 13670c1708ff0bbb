"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The corpus's most frequent words are encoded once and compiled into one automaton
that shares prefixes and suffixes.  Its arcs carry numeric outputs whose sum along
a word is the word's place in a packed table of ids.  The file is memory-mapped by
the workers and walked for many words in lockstep; words outside it are merged
pair by pair, so the result is exact whatever the lexicon holds.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import slices, stage, text_buffer, unstage

#: Words that the transducer holds at most; frequencies are told apart to an eighth of a doubling.
LEXICON_WORDS, STEPS = 100_000, 8
#: Longer words are merged one by one, not looked up.
LEXICON_WORD_BYTES = 48
_WIDTHS = [next(w for w in (8, 12, 16, 24, LEXICON_WORD_BYTES) if n <= w) for n in range(LEXICON_WORD_BYTES + 1)]
#: Distinct words that a worker counts or remembers before it lets go of them.
WORKER_WORDS = 100_000

# The white space of the tokenizer's pattern language.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The tokenizer's own word pattern.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
#: Texts of characters below this use a pattern with plain classes, which is faster.
_NARROW = 0x250

# Lower-case forms that Python's character tables do not have yet.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_is_newer = re.compile("[" + "".join(map(chr, _NEWER)) + "]").search


def _narrow_word() -> re.Pattern:
    """The word pattern with \\p{L} and \\p{N} spelled out for characters below _NARROW."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(_NARROW) if unicodedata.category(chr(c))[0] == k) for k in "LN")
    return re.compile(_WORD.replace(r"\p{L}+|\p{N}|", f"[{letters}]+|[{numbers}]|").replace(r"\p{L}\p{N}", letters + numbers))


_is_wide = re.compile(f"[^\0-{chr(_NARROW - 1)}]").search


def _byte_signs() -> list[str]:
    """A printable sign for each byte: itself where it is printable, else the next free one past 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class WordPairs:
    """Exact byte-pair merges of single words, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A pair of ids gives the rank of its merge; a rank gives the merged id.
        self.rank = {self.ids[a] << 20 | self.ids[b]: k for k, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.token = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.sign = {i: str(i) for i in self.token}
        signs = _byte_signs()
        self.inner = [self.ids.get(c, -1) for c in signs]
        self.last = [self.ids.get(c + self.suffix, -1) for c in signs]
        self.word, self.narrow = regex.compile(_WORD).findall, _narrow_word().findall
        self._keys, self._ranks = self._table()
        self._inner, self._last, self._merged = (np.array(x, np.int64) for x in (self.inner, self.last, self.merged))
        # Ranks of the pairs of single bytes, the second inside a word or at its end.
        self._first = [self._rank_of(np.repeat(self._inner, 256), np.tile(x, 256)).reshape(256, 256) for x in (self._inner, self._last)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token stands as a word of its own, marked by a leading NUL
        (which cannot begin a matched special token's plain form)."""
        if any(t in text for t in self.special):
            out: list[str] = []
            for k, part in enumerate(self.split.split(text)):
                out += ["\0" + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if not _is_wide(text):
            return self.narrow(text)
        return self.word(text.translate(_NEWER) if _is_newer(text) else text)

    def _parts(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        parts = [*map(self.inner.__getitem__, raw)]
        parts[-1] = self.last[raw[-1]]
        return parts

    def merge(self, word: str) -> list[int]:
        """Ids of one word of any length: a heap holds the pairs of a linked list of parts,
        least rank first, leftmost first among equals."""
        if word[:1] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        parts, rank = self._parts(word), self.rank.get
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank(parts[k] << 20 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        gone = -2  # the part was merged into the one before it
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] == gone or j >= n or rank(parts[k] << 20 | parts[j]) != r:
                continue
            parts[k], parts[j] = self.merged[r], gone
            after[k] = i = after[j]
            if i < n:
                before[i] = k
            for a, b in ((before[k], k), (k, i)):
                if a >= 0 and b < n and (r := rank(parts[a] << 20 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing over the pairs: keys and ranks."""
        bits = max(4, (4 * len(self.rank)).bit_length())
        self._shift = np.uint64(64 - bits)
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        ranks = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        slot = self._slot(keys)
        held, value = np.full((1 << bits) + len(keys), -1), np.full((1 << bits) + len(keys), len(self.merged))
        probes, left = 0, np.arange(len(keys))
        while len(left):  # each round, one key for each free slot; the others go on to the next
            at = slot[left] + probes
            _, first = np.unique(at, return_index=True)
            first = first[held[at[first]] < 0]
            held[at[first]], value[at[first]] = keys[left[first]], ranks[left[first]]
            left = np.delete(left, first)
            probes += 1
        return held, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or the number of merges where there is none."""
        key = left << 20 | right
        key[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(key), np.full(len(key), len(self.merged))
        todo = np.arange(len(key))
        while len(todo):
            held = self._keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            slot[todo] += 1
        return out

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.  Words of similar length are merged in lockstep: each round
        merges every word's leftmost pair of least rank, until no word has one."""
        out: list[list[int]] = [[]] * len(words)
        raws = [w.encode("utf-8", "replace") for w in words]
        groups: dict[int, list[int]] = {}
        for k, (w, r) in enumerate(zip(words, raws)):
            if len(r) > LEXICON_WORD_BYTES or (w[:1] == "\0" and w[1:] in self.special):
                out[k] = self.merge(w)
            else:
                groups.setdefault(_WIDTHS[len(r)], []).append(k)
        far = len(self.merged)
        for width, places in groups.items():
            size = np.array([len(raws[k]) for k in places])
            raw = np.frombuffer(b"".join([raws[k].ljust(width, b"\0") for k in places]), np.uint8).reshape(-1, width)
            row, cols = np.arange(len(places)), np.arange(width)
            parts = self._inner[raw]
            parts[row, size - 1] = self._last[raw[row, size - 1]]
            ranks = np.full(parts.shape, far)
            ranks[:, :-1] = self._first[0][raw[:, :-1], raw[:, 1:]]
            x = row[size > 1]
            ranks[x, size[x] - 2] = self._first[1][raw[x, size[x] - 2], raw[x, size[x] - 1]]
            ranks[cols >= size[:, None] - 1] = far
            live = row
            while len(live):
                p, r = parts[live], ranks[live]
                row = np.arange(len(live))
                k = r.argmin(axis=1)
                best = r[row, k]
                if best.max() == far:
                    go = best < far
                    live, p, r, k, best = live[go], p[go], r[go], k[go], best[go]
                    row = row[: len(live)]
                # drop the part after the pair's first, then give that the merged id
                source = np.minimum(cols + (cols > k[:, None]), width - 1) + row[:, None] * width
                p, r = p.ravel()[source], r.ravel()[source]
                size[live] -= 1
                last = size[live] - 1
                p[row, k] = self._merged[best]
                r[row, last] = far
                for at in (k - 1, k):
                    x = row[(at >= 0) & (at < last)]
                    r[x, at[x]] = self._rank_of(p[x, at[x]], p[x, at[x] + 1])
                parts[live], ranks[live] = p, r
            for k, ids, n in zip(places, parts.tolist(), size.tolist()):
                out[k] = ids[:n] if -1 not in ids[:n] else [i for i in ids[:n] if i >= 0]
        return out


def compile_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of ``entries`` as one flat file.

    Words go in sorted order; a state is frozen once no later word can extend it and
    is replaced by an equal frozen one.  Counting accepted words below each arc gives
    the arc's output: the number of words that sort before those through it.
    """
    frozen: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by state: (label, target) pairs
    final: list[bool] = []
    size: list[int] = []  # words accepted from a state

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        at = frozen.get(key)
        if at is None:
            at = frozen[key] = len(arcs)
            arcs.append(key[1])
            final.append(state[0])
            size.append(state[0] + sum(size[t] for _, t in key[1]))
        return at

    path: list[list] = [[False, []]]  # open states of the last word: final, arcs
    last = b""
    words = sorted(entries)
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) > common + 1:
            label = last[len(path) - 2]
            done = freeze(path.pop())
            path[-1][1].append((label, done))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        label = last[len(path) - 2]
        done = freeze(path.pop())
        path[-1][1].append((label, done))
    start = freeze(path[0])
    keys, targets, outputs = [], [], []
    for s, out in enumerate(arcs):
        before = int(final[s])
        for label, t in out:
            keys.append(s << 8 | label)
            targets.append(t)
            outputs.append(before)
            before += size[t]
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)])
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array(final, np.uint8),
        ends.astype(np.int32), np.array([i for x in ids for i in x], np.int32),
    ]
    head = np.array([start, *map(len, parts)], np.int64).tobytes()
    body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
    return head + body


class Transducer:
    """A compiled lexicon, memory-mapped and read in place."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 7)
        self.start, at, parts = int(head[0]), 56, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.outputs, self.final, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the id table, or -1, by walking all of them in lockstep."""
        n = len(words)
        place = np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        state = np.full(n, self.start, np.int64)
        live = np.flatnonzero(length > 0)
        place[length == 0] = -1
        step = 0
        while len(live):
            key = state[live] << 8 | raw[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            place[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live] = self.targets[arc]
            place[live] += self.outputs[arc]
            step += 1
            done = length[live] == step
            ended = live[done]
            place[ended[self.final[state[ended]] == 0]] = -1
            live = live[~done]
        return place

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.ends[place] : self.ends[place + 1]].tolist()


class _Coder:
    """Words to printed ids and printed tokens; what it remembers is bounded."""

    def __init__(self, pairs: WordPairs, lexicon: Transducer | None):
        self.pairs, self.lexicon = pairs, lexicon
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > WORKER_WORDS:
            self.release()
        new = list(words - self.ids.keys())
        at = self.lexicon.places([w.encode("utf-8", "replace") for w in new]).tolist() if self.lexicon else [-1] * len(new)
        unseen = iter(self.pairs.merge_many([w for w, k in zip(new, at) if k < 0]))
        token, sign = self.pairs.token.__getitem__, self.pairs.sign.__getitem__
        for w, k in zip(new, at):
            ids = next(unseen) if k < 0 else self.lexicon.ids_at(k)
            self.ids[w] = " ".join(map(sign, ids))
            self.tokens[w] = " ".join(map(token, ids))

    def release(self) -> None:
        self.ids.clear()
        self.tokens.clear()

    def forget(self, words: set[str]) -> None:
        for w in words:
            if len(w) > 64:
                self.ids.pop(w, None)
                self.tokens.pop(w, None)


@functools.lru_cache(maxsize=2)
def _pairs(path: str) -> WordPairs:
    return WordPairs(path)


@functools.lru_cache(maxsize=1)
def _coder(tokenizer: str, lexicon: str) -> _Coder:
    return _Coder(_pairs(tokenizer), Transducer(SparkFiles.get(lexicon)))


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """word, n over all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _pairs(tokenizer).words
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return done

        for part in parts:
            for text in part.column(0):
                held.update(words(text.as_py() or ""))
                if len(held) > WORKER_WORDS:
                    yield out()
        yield out()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, ``size`` at most; returns the name of the file, which
    Spark hands to every executor, later ones included.

    All texts are counted.  A histogram of the logarithms of counts tells from which
    count on the words fit, so that no more than ``size`` words reach the driver.
    """
    counts = stage(word_counts(docs, tokenizer, text_col).where(F.octet_length("word") <= LEXICON_WORD_BYTES).withColumn("class", F.floor(F.log2("n") * STEPS).cast("int")), "word-counts")
    held, least = 0, None
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():  # 63 * STEPS rows at most
        held += r["count"]
        if held > size:
            break
        least = r["class"]
    top = [] if least is None else [r["word"] for r in counts.where(F.col("class") >= least).select("word").collect()]
    unstage(counts)
    pairs = _pairs(tokenizer)
    data = compile_transducer({w.encode(): ids for w, ids in zip(top, pairs.merge_many(top))})
    name = f"oxbow-lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sc = docs.sparkSession.sparkContext
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        d = tempfile.mkdtemp(prefix="oxbow-")  # the driver serves the file from here as long as it lives
        atexit.register(shutil.rmtree, d, True)
        path = os.path.join(d, name)
        with open(path, "wb") as f:
            f.write(data)
        sc.addFile(path)
    return name


def encode_decode(docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ``arrays``
    also ids (array of int) and decoded (string).

    Null or empty text: no tokens, digests of the empty string.  Rows are coded one
    by one, so repeated rows, null ids and ties need no care; other columns are not read.
    A very long text or word is coded whole by one task, in time near its length.  An
    empty table gives an empty table, and its lexicon is empty.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if arrays else [])]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer, lexicon)
        words_of, sha = coder.pairs.words, hashlib.sha256
        for part in parts:
            _, offsets = text_buffer(part.column(1))
            for i, j in slices(offsets, 1 << 20):
                found = [words_of(t.as_py() or "") for t in part.column(1).slice(i, j - i)]
                every = set().union(*found)
                coder.learn(every)
                ids_of, tokens_of = coder.ids.__getitem__, coder.tokens.__getitem__
                n, a, b, more = [], [], [], ([], [])
                for words in found:
                    ids = " ".join(map(ids_of, words))
                    text = " ".join(map(tokens_of, words))
                    n.append(ids.count(" ") + 1 if ids else 0)
                    a.append(sha(ids.encode()).hexdigest())
                    b.append(sha(text.encode()).hexdigest())
                    if arrays:
                        more[0].append(np.array(ids.split(), np.int32))
                        more[1].append(text)
                cols = [part.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if arrays:
                    cols += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                coder.forget(every)
        coder.release()  # a worker outlives its task and waits beside those of later stages
        pa.default_memory_pool().release_unused()

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if arrays else ""))
