"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words.

A word (maximal run without ASCII white space) that lies in a window of 13
words whose word sequence also starts in a document with a smaller id is
removed; overlapping windows merge into maximal removal intervals, judged on
the input alone.

Documents are dealt to blocks of about equal length by ranges of their id, so of
two blocks the earlier has the smaller ids; an id that many rows repeat is dealt
to several blocks, none of them smaller than the other.  Each block hashes all its windows, keeps every
hash once, and sends its sorted hashes, as differences of seven bytes, to the
task that owns that range of hashes.  There the hashes of all blocks meet and
are counted in block order, and each block gets back the hashes that an
earlier block has.  Inside a block the first document of a hash is known
without asking.  A passage that a third of all documents share thus counts
once for each block, not for each document.

Windows are told apart by a 64-bit hash and, as all hashes of one owner begin
alike, by as many bits of a second, independent one: with 2**b owners two different
windows among n agree with odds of n^2 / 2^(65 + b).  As there is an owner for every
2^21 windows, that is about n / 2^44, whatever the size.  Null texts count as empty and have no words; null ids
count as greater than all others; rows that repeat an id count as parts of one
document, none smaller than the other, so a tie removes nothing; a very long text
is one block by itself and read whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.bpe import Memo
from corvane.llm.common import range_cuts, session

#: About so many characters a block and windows a range of hashes.
BLOCK_CHARS, RANGE_WINDOWS = 6 << 20, 1 << 21
_STEP = 7
_ESCAPE = (1 << 8 * _STEP) - 1
_BASE, _SECOND = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


@lru_cache(maxsize=1)
def _hasher() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 500_000)


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the second hash's base and of its inverse."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_SECOND, pow(_SECOND, -1, 1 << 64)))


def _second(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """An independent hash of the windows at ``starts``: a polynomial of other values in another base, by sums."""
    up, down = _powers(1 << max(1, len(hashes)).bit_length())
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(_finish(hashes * np.uint64(_SECOND) + np.uint64(1)) * down[: len(hashes)], out=sums[1:])
    return _finish((sums[starts + window] - sums[starts]) * up[starts])


class Block:
    """The words and windows of some documents, in ascending order of their ids; ``bits`` of a second hash go with the first."""

    def __init__(self, table: pa.Table, window: int, bits: int) -> None:
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        texts = table.column("text")
        self.ids = [ids[i] for i in order]
        self.words = [texts[i].as_py().split() for i in order]
        self.lens = np.fromiter(map(len, self.words), np.int64, len(order))
        rank = np.cumsum([k > 0 and self.ids[k] != self.ids[k - 1] for k in range(len(order))]) if order else np.empty(0, np.int64)
        n = int(self.lens.sum())
        hashes = np.fromiter(map(_hasher().__getitem__, chain.from_iterable(self.words)), np.uint64, n)
        self.window, m = window, max(0, n - window + 1)
        rolled = np.zeros(m, np.uint64)
        for i in range(window):  # the Rabin-Karp polynomial of each window, all at once
            rolled *= np.uint64(_BASE)
            rolled += hashes[i : i + m]
        ends = np.repeat(np.cumsum(self.lens), self.lens)[:m]
        self.starts = np.flatnonzero(np.arange(m) + window <= ends)  # windows inside one document
        found = _finish(rolled[self.starts])
        more = _second(hashes, self.starts, window) >> np.uint64(64 - bits)
        self.n = n
        # of each hash the first window, and whether a window's hash starts in an earlier document of this block
        by = np.argsort(found, kind="stable")
        if np.any((found[by[1:]] == found[by[:-1]]) & (more[by[1:]] != more[by[:-1]])):
            by = np.lexsort((more, found))
        ordered, second = found[by], more[by]
        new = np.ones(len(by), bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])
        self.distinct = ordered[new]
        # what an owner sees of a hash: without the bits that say whose it is, with as many of the second
        self.keys = self.distinct << np.uint64(bits) | second[new]
        self.owner = (self.distinct >> np.uint64(64 - bits)).astype(np.int64)
        ranks = np.repeat(rank, self.lens)[self.starts]
        first = ranks[by][new]
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.cumsum(new) - 1
        self.seen = ranks > first[self.place] if len(by) else np.empty(0, bool)

    def covered(self, elsewhere: dict[int, np.ndarray]) -> np.ndarray:
        """A mask of the words to remove; ``elsewhere``: by owner, sorted keys that earlier blocks have."""
        known = np.zeros(len(self.keys), bool)
        for owner, keys in elsewhere.items():
            own = slice(*np.searchsorted(self.owner, [owner, owner + 1]))
            known[own] = np.isin(self.keys[own], keys, assume_unique=True)
        remove = self.seen | known[self.place] if len(self.starts) else self.seen
        edges = np.zeros(self.n + 1, np.int64)
        at = self.starts[remove]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as seven-byte differences; greater ones follow whole."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    big = steps >= _ESCAPE
    small = np.where(big, np.uint64(_ESCAPE), steps).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_STEP]
    return len(hashes).to_bytes(8, "little") + small.tobytes() + steps[big].astype("<u8").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :_STEP] = np.frombuffer(packed, np.uint8, _STEP * n, 8).reshape(n, _STEP)
    steps = steps.reshape(-1).view("<u8")
    steps[steps == _ESCAPE] = np.frombuffer(packed, "<u8", offset=8 + _STEP * n)
    return np.cumsum(steps, dtype=np.uint64)


@dataclass(frozen=True)
class Deal:
    """How documents are dealt to blocks: by ranges of their ids, a range of one id alone to several blocks if it is long.

    Range k holds the ids in (cut before, cut]; one more follows the last cut,
    and the null ids come last.  ``first[k]`` is the first block of range k.
    """

    cuts: np.ndarray
    first: np.ndarray
    chars: int = 0

    @classmethod
    def of(cls, rows: DataFrame, block_chars: int, least: int) -> Deal:
        """Ranges of about ``block_chars`` characters.  The driver gets a row for each."""
        sizes = rows.select(F.col("doc_id").alias("value"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("weight"))
        one = sizes.agg(F.sum("weight").alias("chars"), F.sum(F.when(F.col("value").isNull(), F.col("weight"))).alias("none")).first()
        total, none = one["chars"] or 0, one["none"] or 0
        size = max(1, min(block_chars, total // least))
        found = range_cuts(sizes, size)
        split = lambda weight, n: max(1, min(n, -(-weight // size)))
        # an id of many rows gets several blocks, other ids one, and the null ids, which come last, as many as they fill
        parts = [split(r["weight"], r["rows"]) if r["own"] else 1 for r in found] + [1, split(none, none)]
        return cls(np.array([r["cut"] for r in found], np.int64), np.concatenate([[0], np.cumsum(parts)]), total)

    def block(self) -> Column:
        """The block of a row with ``doc_id`` and ``text``; found by bisection, on eight bytes a row."""

        @F.arrow_udf("int")
        def found(ids: pa.Array, salt: pa.Array) -> pa.Array:
            known, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            k = np.where(null, len(self.cuts) + 1, np.searchsorted(self.cuts, known, "left"))
            n = self.first[k + 1] - self.first[k]
            return pa.array(self.first[k] + salt.to_numpy(zero_copy_only=False) % n, pa.int32())

        return found("doc_id", F.pmod(F.hash("text"), F.lit(1 << 20)))

    def range_of(self, blocks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, blocks, "right") - 1


def remove_repeats(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_words, n_removed, removed`` (intervals of word positions), ``kept`` (text) of each row."""
    spark = session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    least = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = Deal.of(rows, block_chars, least)
    bits = max(least, deal.chars // 6 // RANGE_WINDOWS).bit_length()  # 2**bits ranges of hashes
    blocks = rows.withColumn("block", deal.block())

    def hashed(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, window, bits)
        names, at = np.unique(block.owner, return_index=True)
        packed = [pack(x) for x in np.split(block.keys, at[1:])] if len(names) else []
        return pa.table({"owner": pa.array(names, pa.int64()), "block": pa.array([key[0].as_py()] * len(names), pa.int32()), "hashes": pa.array(packed, pa.binary())})

    def met(key: tuple, table: pa.Table) -> pa.Table:
        numbers = table.column("block").to_pylist()
        order = sorted(range(len(numbers)), key=numbers.__getitem__)
        parts = [unpack(table.column("hashes")[i].as_py()) for i in order]
        joined = np.concatenate(parts)
        whose = np.repeat(np.array([numbers[i] for i in order], np.int32), list(map(len, parts)))
        by = np.argsort(joined, kind="stable")
        joined, whose = joined[by], whose[by]
        # the first of equal hashes is in the earliest block; blocks of one range hold one id, none before the other
        new = np.ones(len(by), bool)
        new[1:] = joined[1:] != joined[:-1]
        ranges = deal.range_of(whose)
        again = ranges > ranges[new][np.cumsum(new) - 1] if len(by) else ~new
        joined, whose = joined[again], whose[again]
        by = np.argsort(whose, kind="stable")
        joined, whose = joined[by], whose[by]
        names, at = np.unique(whose, return_index=True)
        packed = [pack(x) for x in np.split(joined, at[1:])] if len(joined) else []
        return pa.table({"block": pa.array(names, pa.int32()), "owner": pa.array([key[0].as_py()] * len(names), pa.int64()), "hashes": pa.array(packed, pa.binary())})

    def kept(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts, window, bits)
        mask = block.covered({o.as_py(): unpack(x.as_py()) for o, x in zip(answers.column("owner"), answers.column("hashes"), strict=True)})
        out, at = {"doc_id": block.ids, "n_words": [], "n_removed": [], "removed": [], "kept": []}, 0
        for words, n in zip(block.words, block.lens.tolist(), strict=True):
            own = mask[at : at + n]
            at += n
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            out["n_words"].append(n)
            out["n_removed"].append(int(own.sum()))
            out["removed"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            cut = edges.tolist()
            spans = zip([0, *cut[1::2]], [*cut[0::2], n], strict=True)
            out["kept"].append(b" ".join(w for a, b in spans for w in words[a:b]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], span), pa.array(out["kept"], pa.string())], names=list(out))

    sent = blocks.groupBy("block").applyInArrow(hashed, "owner long, block int, hashes binary")
    answers = sent.groupBy("owner").applyInArrow(met, "block int, owner long, hashes binary")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kept, schema)
