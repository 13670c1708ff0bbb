"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries failure links and, for each node, the number of
pieces that following its link emits.  One pass over a word's characters then
gives the number of greedy longest-match pieces; no piece is ever built.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WORD = regex.compile(r"\w+|[^\w\s]")
_SHIFT = 21  # a code point has at most 21 bits
_UNKNOWN = 1 << 40


class PieceCounter:
    """Counts greedy pieces of words over word-initial and continuing pieces."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.step: dict[int, int] = {}
        ends: set[int] = set()
        depth_order: list[tuple[int, int, int]] = []  # parent, character, node
        nodes = 2  # 0: word start, 1: inside a word
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for ch in map(ord, piece):
                    key = at << _SHIFT | ch
                    to = self.step.get(key)
                    if to is None:
                        to = self.step[key] = nodes
                        depth_order.append((at, ch, to))
                        nodes += 1
                    at = to
                if at > 1:
                    ends.add(at)
        self.link = [-1] * nodes
        self.pops = [0] * nodes
        depth = [0] * nodes
        for parent, _, node in depth_order:
            depth[node] = depth[parent] + 1
        for parent, ch, node in sorted(depth_order, key=lambda e: depth[e[2]]):
            if node in ends:
                self.link[node], self.pops[node] = 1, 1
                continue
            back, popped = self.link[parent], self.pops[parent]
            while back >= 0 and (back << _SHIFT | ch) not in self.step:
                popped += self.pops[back]
                back = self.link[back]
            if back >= 0:
                self.link[node], self.pops[node] = self.step[back << _SHIFT | ch], popped

    def count(self, word: str) -> int:
        """Number of pieces; -1 if the pieces cannot spell the word."""
        step, link, pops = self.step, self.link, self.pops
        at = n = 0
        for ch in map(ord, word):
            while (to := step.get(at << _SHIFT | ch)) is None:
                if link[at] < 0:
                    return -1
                n += pops[at]
                at = link[at]
            at = to
        while at > 1:
            if link[at] < 0:
                return -1
            n += pops[at]
            at = link[at]
        return n


class _Memo(dict):
    """Counts of recent words; bounded, so a worker's memory is."""

    LIMIT = 400_000

    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word)
        n = 1 + _UNKNOWN if n < 0 else n
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def pieces_of(model: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentence-piece file: those with and
    without the word mark.  Control and byte pieces spell no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    mark = "▁"
    return (
        [p[1:] for p in pieces if p.startswith(mark) and len(p) > 1 and mark not in p[1:]],
        [p for p in pieces if mark not in p],
    )


@functools.lru_cache(maxsize=2)
def _memo(model: str) -> _Memo:
    return _Memo(PieceCounter(*pieces_of(model)))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row.

    Words are runs of word characters or single other signs.  A word that the
    pieces cannot spell counts as one unknown token.  Null or empty text: zeros.
    Repeated rows and null ids are counted row by row; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(model)
        find = WORD.findall
        for part in parts:
            words, tokens, unknown = [], [], []
            for text in part.column(1):
                found = find(text.as_py() or "")
                total = sum(map(memo.__getitem__, found))
                words.append(len(found))
                tokens.append(total % _UNKNOWN)
                unknown.append(total // _UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_tokens long, n_unknown long")
