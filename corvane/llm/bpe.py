"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of pre-tokens form linked lists.  Every adjacent pair that the
vocabulary can merge is put into the bucket of its merge rank; a two-level
bitmap marks the buckets that are not empty, so that find-first-set names the
next rank in constant time however long a pre-token is.  Entries whose pair
has changed since are stale and are skipped when met.  A pre-token of n bytes
costs O(n log n) at worst (the log orders equal ranks by position), against
O(n^2) for repeated scans.

One queue serves all unknown pre-tokens of a batch: pre-tokens do not touch each
other, so taking the lowest rank of all keeps the order of merges in each.  A
bucket that many pre-tokens share is merged by array operations, each one's
leftmost entry at a time; any other is merged entry by entry.

Texts are cut into pre-tokens by the vocabulary's pattern; results are kept per
worker in bounded memos, as words repeat.  Null texts count as empty; an empty
text has no ids; an empty table gives an empty result.  Extra columns are
ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.common import gathered, session, uncollected

#: Entries of each memo in a worker; a full memo starts anew.
MEMO = 300_000
#: A bucket of at least so many entries is merged by array operations, if they lie in as many pre-tokens.
SHARED = 24
#: Bytes of text that are encoded together.
GATHER = 4 << 20


class Memo(dict):
    """A bounded dict that computes what it lacks; ``map(memo.__getitem__, keys)`` runs in C.

    When half of ``limit`` is full, what is held moves aside and is looked up
    there before it is computed again; so what is used often stays, and what is
    not goes with the next turn.
    """

    made: list[Memo] = []

    def __init__(self, make, limit: int = MEMO) -> None:
        super().__init__()
        self.make, self.half, self.aside = make, limit // 2, {}
        Memo.made.append(self)

    @staticmethod
    def only(*memos: Memo) -> None:
        """Empty all other memos of this worker, which served operators that ran here before."""
        for memo in Memo.made:
            if not any(memo is m for m in memos):
                memo.clear()
                memo.aside = {}

    def __missing__(self, key):
        if (value := self.aside.get(key)) is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.aside = dict(self)
            self.clear()
        self[key] = value

    def find(self, key):
        """The value of ``key`` if it is held, else None."""
        if (value := self.get(key)) is None and (value := self.aside.get(key)) is not None:
            self.put(key, value)
        return value


class ByteBPE:
    """A rank vocabulary: merges are tried lowest rank first, leftmost first."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 18 or any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("the vocabulary needs all single bytes and ranks below 2**18")
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.leaves = [0] * 1024  # the rank bitmap; all zero between calls
        # every pair of tokens that makes a token, as first << 18 | second, sorted, with the rank of what it makes
        keys, made = [], []
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                if (x := self.ranks.get(piece[:k])) is not None and (y := self.ranks.get(piece[k:])) is not None:
                    keys.append(x << 18 | y)
                    made.append(rank)
        by = np.argsort(np.array(keys or [-1], np.int64), kind="stable")
        self.pairs, self.made = np.array(keys or [-1], np.int64)[by], np.array(made or [-1], np.int32)[by]
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.findall = regex.compile(pattern).findall
        self.tokens, self.chunks = Memo(lambda token: self.merge([token.encode()])[0]), {}

    def _rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of tokens; -1 for none."""
        key = first.astype(np.int64) << 18 | second
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token; one that is a token itself is not merged."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = iter(self._merge([p for p, r in zip(pieces, whole, strict=True) if r is None]))
        return [next(rest) if r is None else r.to_bytes(4, "little") for r in whole]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token from its single bytes on.

        ``leaves`` has a bit for each rank and ``top`` one for each leaf that is
        not empty; a bucket is a list of positions.
        """
        data, rank_of, leaves, top = b"".join(pieces), self.ranks.get, self.leaves, 0
        n = len(data)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lens)
        whole = np.repeat(ends, lens).astype(np.int32)  # where each position's pre-token ends
        ids = self.bytes[np.frombuffer(data, np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)  # where the token that starts here ends, and the next one starts
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - lens)[lens > 0]] = -1
        waiting = np.full(n + 1, -1, np.int32)  # the rank under which the pair that starts here is queued
        starts = np.ones(n, bool)
        ids_, after_, before_, waiting_, whole_, starts_ = map(memoryview, (ids, after, before, waiting, whole, starts))
        buckets: dict[int, list[int]] = {}

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            if not len(at):
                return
            waiting[at] = ranks
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1))
            flat = at.tolist()
            for rank, a, b in zip(ranks[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(flat)], strict=True):
                if (bucket := buckets.get(rank)) is None:
                    buckets[rank] = flat[a:b]
                    leaves[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                else:
                    bucket += flat[a:b]

        if n:
            ranks = self._rank(ids[:-1], ids[1:])
            ranks[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)] - 1] = -1
            at = np.flatnonzero(ranks >= 0)
            push(at.astype(np.int32), ranks[at])
        while top:
            leaf = (top & -top).bit_length() - 1  # find-first-set, twice
            bits = leaves[leaf]
            low = bits & -bits
            rank = leaf << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) >= SHARED:
                at = np.array(bucket, np.int32)
                at = np.unique(at[waiting[at] == rank])  # without the stale
                first = np.ones(len(at), bool)
                first[1:] = whole[at[1:]] != whole[at[:-1]]
                if 2 * np.count_nonzero(first) > len(at):
                    if len(rest := at[~first]):
                        buckets[rank] = rest.tolist()
                    else:
                        del buckets[rank]
                        leaves[leaf] = bits ^ low
                        if bits == low:
                            top ^= 1 << leaf
                    i = at[first]
                    j = after[i]
                    end = after[j]
                    after[i], ids[i], starts[j] = end, rank, False
                    waiting[i] = waiting[j] = -1
                    right = end < whole[i]
                    before[end[right]] = i[right]
                    left = before[i] >= 0
                    x, y = np.concatenate([i[right], before[i[left]]]), np.concatenate([end[right], i[left]])
                    ranks = self._rank(ids[x], ids[y])
                    waiting[x] = -1
                    push(x[ranks >= 0], ranks[ranks >= 0])
                    continue
            bucket.sort(reverse=True)
            lower = False
            while bucket and not lower:
                i = bucket.pop()
                if waiting_[i] != rank:
                    continue  # stale: this pair has changed since
                j = after_[i]
                end = after_[i] = after_[j]
                ids_[i], starts_[j], waiting_[j], waiting_[i] = rank, False, -1, -1
                fresh = ()
                if end < whole_[i]:
                    before_[end] = i
                    if (r := rank_of(data[i : after_[end]])) is not None:
                        fresh = ((i, r),)
                if (j := before_[i]) >= 0:
                    if (r := rank_of(data[j:end])) is None:
                        waiting_[j] = -1
                    else:
                        fresh += ((j, r),)
                for k, r in fresh:
                    waiting_[k] = r
                    if (other := buckets.get(r)) is None:
                        buckets[r] = [k]
                        leaves[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    else:
                        other.append(k)
                    lower = lower or r < rank
            if not bucket:
                del buckets[rank]
                leaves[leaf] = bits = leaves[leaf] ^ low
                if not bits:
                    top ^= 1 << leaf
        packed = ids[starts].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(starts)])[ends]
        cuts = (4 * counts).tolist()
        return [packed[a:b] for a, b in pairwise([0, *cuts])]

    def _cut(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk between spaces; without a line break at its start, a space stood before it."""
        return self.findall(chunk if chunk[:1] == "\n" else f" {chunk}")

    def _parts(self, text: str) -> tuple[list[str], list[str]]:
        """A text's pre-tokens and the chunks that follow them.

        Single white-space characters between words separate pre-tokens
        whatever stands around them, so such texts are cut there and chunks
        are looked up; any other text goes through the pattern as a whole.
        """
        words = text.split()
        if not words or sum(map(len, words)) + len(words) - 1 != len(text):
            return self.findall(text), []
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.findall(first), rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers; unknown pre-tokens are merged together.

        Chunks are kept from one call to the next, pre-tokens for longer.
        """
        parts = list(map(self._parts, texts))
        chunks = set().union(*(rest for _, rest in parts))
        found = {c: self.chunks[c] for c in chunks & self.chunks.keys()}
        cuts = {c: self._cut(c) for c in chunks if c not in found}
        held = dict.fromkeys(set().union(*(tokens for tokens, _ in parts), *cuts.values()))
        for token in held:
            held[token] = self.tokens.find(token)
        new = [t for t, ids in held.items() if ids is None]
        for token, ids in zip(new, self.merge([t.encode() for t in new]), strict=True):
            held[token] = ids
            self.tokens.put(token, ids)
        of = held.__getitem__
        for chunk, tokens in cuts.items():
            found[chunk] = b"".join(map(of, tokens))
        self.chunks = found
        return [b"".join(map(of, tokens)) + b"".join(map(found.__getitem__, rest)) for tokens, rest in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit) of each row.

    ``with_decoded`` adds ``decoded``, as :func:`decode` does, in the same pass: a
    second Python step would hold a second worker, with its own vocabulary and
    memos, for every task.

    ``vocabulary`` is the path of a rank file that every executor has.
    """
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if with_decoded:
        out = out.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(vocabulary, pattern)
        Memo.only(one.tokens)
        for batch in gathered(batches, 1, GATHER):
            with uncollected():
                ids = one.encode(batch.column(1).to_pylist())
            n = [len(x) >> 2 for x in ids]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array(list(map(one.decode, ids)), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])
        one.chunks = {}

    return rows.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The rows of :func:`encode` with ``decoded`` (binary: the bytes that the ids stand for)."""
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_one = codec(vocabulary, pattern).decode
        for batch in batches:
            texts = pa.array([decode_one(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, out)


def unpack(column: str) -> F.Column:
    """The packed ids as ``array<bigint>``, for users who want a list."""
    hexed, n = F.hex(column), F.floor(F.length(column) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.concat(*[F.substr(hexed, i * 8 + F.lit(7 - 2 * k), F.lit(2)) for k in range(4)]), 16, 10).cast("bigint"))
