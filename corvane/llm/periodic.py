"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words of one text with smallest period q that
no neighbouring word extends and that is ``exponent`` periods long, and
``least`` words.  A run holds, for the power of two m with q <= m < 2 q, one of
the dyadic blocks of m words that begin at multiples of m / 2, and this block's
next occurrence, which is q words on; no block of q words or more occurs nearer
in its run.  So each block is asked for its next occurrence in the window of m
words after its start:

* The suffixes are sorted by prefix doubling, as deep as the longest block that
  is asked.  All occurrences of a block are an interval of this suffix array.
* A wavelet tree over the suffix array answers the range successor: the least
  position of that interval after the block.  It is one step of the progression
  of occurrences that the run holds, hence a candidate period.
* A candidate is extended both ways as far as words one period apart are the same.

A block needs no look-up if one of its words does not recur within m words; in
prose that is nearly all of them, and texts in which no block is left are not sorted.

Texts are independent, so rows stay where they are: one narrow stage, no shuffle,
batches of some megabytes; memory grows with the longest text.  Null texts count as empty
and have no words; null ids and rows that repeat an id are texts of their own;
runs of equal start are ordered by period; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import gathered, session, uncollected

#: Bytes of text whose words are searched together.
BATCH_BYTES = 4 << 20


class WaveletTree:
    """Bit rows of ``values`` from the highest bit down, each row dealt by the bits above; counts by 64 bits."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.rows, values = [], values.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.rows.append((level, words, before, len(bit) - int(before[-1])))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before ``at``."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of ``values[low:high]`` are less than ``bound``."""
        found = np.zeros(len(low), np.int64)
        for level, words, before, zeros in self.rows:
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            one = (bound >> level & 1).astype(bool)
            found += np.where(one, high - low - b + a, 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th least, from 0, of ``values[low:high]``."""
        found = np.zeros(len(low), np.int64)
        for level, words, before, zeros in self.rows:
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            less = high - low - b + a
            one = n >= less
            found += one.astype(np.int64) << level
            n = np.where(one, n - less, n)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The least of ``values[low:high]`` that exceeds ``after``, or -1."""
        n = self.below(low, high, after + 1)
        some = n < high - low
        found = np.full(len(low), -1, np.int64)
        found[some] = self.nth(low[some], high[some], n[some])
        return found


def next_same(words: np.ndarray) -> np.ndarray:
    """How far on the same word stands next; beyond the end if nowhere."""
    by = np.argsort(words, kind="stable")
    found = np.full(len(words), len(words) + 1, np.int64)
    same = words[by[1:]] == words[by[:-1]]
    found[by[:-1][same]] = (by[1:] - by[:-1])[same]
    return found


def blocks(ahead: np.ndarray, longest: int) -> list[np.ndarray]:
    """By k: where a dyadic block of 2**k words begins all of whose words recur within 2**k words."""
    out, row, k = [np.flatnonzero(ahead <= 1)], ahead, 1
    while 1 << k <= longest:
        half = 1 << k - 1
        out.append(np.flatnonzero(np.maximum(row[:-1], row[1:]) <= 1 << k) * half)
        row = np.maximum(row[: len(row) // 2 * 2 : 2], row[1::2])  # a last half block cannot begin a whole one
        k += 1
    return out


def intervals(words: np.ndarray, asked: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The suffix array, as deep as the longest block asked, and each block's interval of it, by k."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank, found, depth = np.empty(n + 1, np.int64), [], 1
    rank[n] = -1
    deepest = max(k for k, a in enumerate(asked) if len(a))
    for k in range(deepest + 1):
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(starts, append=n))
        low = rank[asked[k]]
        found.append((low, np.append(starts, n)[np.searchsorted(starts, low) + 1]))
        if k < deepest:
            open_ = ~new
            open_[:-1] |= ~new[1:]
            left = np.flatnonzero(open_)  # slots of suffixes that still tie with another
            own, ahead = rank[order[left]], rank[np.minimum(order[left] + depth, n)]
            by = np.lexsort((ahead, own))
            order[left], ahead = order[left][by], ahead[by]
            new[left[1:]] |= ahead[1:] != ahead[:-1]
            depth *= 2
    return order, found


def find(words: np.ndarray, ends: np.ndarray, *, least: int = 6, exponent: int = 4) -> np.ndarray:
    """``start, length, period`` of every run of texts that end at ``ends`` and share no number of ``words``, by start and period."""
    sizes = np.diff(ends, prepend=0)
    none = np.empty((0, 3), np.int64)
    if len(words) < 2:
        return none
    asked = blocks(next_same(words), max(1, int(sizes.max()) // 2))
    of = [np.searchsorted(ends, a, "right") for a in asked]
    docs = np.unique(np.concatenate(of))
    if not len(docs):
        return none
    # only texts with a block to look up are sorted
    begin = ends - sizes
    inside = np.concatenate([np.arange(begin[d], ends[d]) for d in docs])
    shift = begin[docs] - np.concatenate([[0], np.cumsum(sizes[docs])[:-1]])
    own = [a - shift[np.searchsorted(docs, o)] for a, o in zip(asked, of, strict=True)]
    order, found = intervals(words[inside], own)
    tree = WaveletTree(order, len(inside).bit_length())
    seen = []
    for k, (low, high) in enumerate(found):
        step = tree.successor(low, high, own[k]) - own[k]
        near = (step > 0) & (step <= 1 << k)
        seen.append(np.stack([of[k][near], step[near], asked[k][near]], 1))
    seen = np.concatenate(seen)
    seen = seen[np.lexsort(seen.T[::-1])]
    runs, cuts = [], np.flatnonzero(np.any(seen[1:, :2] != seen[:-1, :2], axis=1)) + 1
    for same in np.split(seen, cuts) if len(seen) else []:
        doc, q = int(same[0, 0]), int(same[0, 1])
        a, z = int(begin[doc]), int(ends[doc])
        breaks = np.concatenate([[-1], np.flatnonzero(words[a : z - q] != words[a + q : z]), [z - a - q]])
        at = np.unique(np.searchsorted(breaks, same[:, 2] - a, "right"))  # between which breaks the blocks lie
        start = breaks[at - 1] + 1
        length = breaks[at] - start + q
        good = length >= max(least, exponent * q)
        runs.append(np.stack([start[good] + a, length[good], np.full(good.sum(), q)], 1))
    runs = np.concatenate(runs) if runs else none
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _searched(batch: pa.RecordBatch, least: int, exponent: int) -> pa.RecordBatch:
    texts, number = [t.split() for t in batch.column(1).to_pylist()], count()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for t in texts:  # numbers by first use, never the same in two texts
        words[at : at + len(t)] = np.fromiter(map(defaultdict(number.__next__).__getitem__, t), np.int64, len(t))
        at += len(t)
    ends = np.cumsum(sizes)
    runs = find(words, ends, least=least, exponent=exponent)
    doc = np.searchsorted(ends, runs[:, 0], "right")
    found, kept = [[] for _ in texts], texts[:]
    for d in np.unique(doc).tolist():
        own = runs[doc == d] if len(runs) < 64 else runs[slice(*np.searchsorted(doc, [d, d + 1]))]
        own[:, 0] -= ends[d] - sizes[d]
        found[d] = [dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()]
        depth = np.zeros(int(sizes[d]) + 1, np.int64)
        np.add.at(depth, own[:, 0] + own[:, 2], 1)
        np.add.at(depth, own[:, 0] + own[:, 1], -1)
        t = texts[d]
        kept[d] = [t[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    joined = pa.array([b" ".join(t) for t in kept], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), joined], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row: in ``collapsed`` every run keeps its first period only."""
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            for batch in gathered(batches, 1, BATCH_BYTES):
                yield _searched(batch, least, exponent)

    return rows.mapInArrow(searched, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
