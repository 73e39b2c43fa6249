"""Suffix-array dedup: bytes that a string of fixed length covers go if it starts anywhere else, too.

Texts are UTF-8 bytes; a suffix stands for the ``window`` (200) bytes that start
there, inside one document.  Its leading token is the least hash of the grams
(100 bytes) in these bytes, the first of equal ones, and ``d`` their distance:
equal strings have equal leading tokens at equal ``d``.  Neighbouring suffixes
that share the gram they are led by form one *piece*, some 240 bytes for 45
suffixes, so that suffixes travel, sort and are looked up in packs.

1. Documents are dealt to blocks by hash.  A block sends the leading token of
   each distinct piece, with the piece's digest, to the owner of the token.
   A suffix whose leading token no other piece has is without a partner.
   Equal pieces collapse to one, which stands for all of them: each has a partner.
   Where a token leads different pieces, one of each kind is opened.
2. The suffixes of opened pieces are range-partitioned by (leading token, d,
   bytes) with sampled splitters; a piece is cut where a splitter falls inside.
   Suffixes equal to a splitter that was sampled more than once are spread over
   the buckets between, so a hot token or string is no single task's.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time:
   what is alone drops out, what ties goes on to the next eight.  Neighbours
   that tie to the end mark each other.  First and last suffixes of buckets
   are compared across the boundaries.
4. The marks return to the blocks, which remove what is covered.

Candidates are held against each other by bytes; only whole pieces collapse by a
64-bit digest among those of one 64-bit token.

Null texts count as empty; null ids and rows that repeat an id are documents of
their own; extra columns are ignored; an empty table gives an empty result.  A
text of any length is hashed a megabyte at a time, in the one task that holds its
row.  Ties have no order: all places of a repeated string lose it.  As a cut may
fall inside a character, what is kept is binary.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import materialize, session

#: About so many bytes a block, pieces an owner of tokens, and suffixes a bucket.
BLOCK_BYTES, OWNER_PIECES, BUCKET_SUFFIXES = 6 << 20, 1 << 20, 1 << 19
#: Buckets and sampled suffixes at most, whatever the input: beyond, buckets grow, and are sorted class by class.
MOST_BUCKETS, MOST_SAMPLED = 1 << 14, 1 << 16
#: Positions hashed at a time; their numbers fill the low bits of what grams are compared by.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WHOLE, _OPEN = 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, the powers of the base and of its inverse."""
    values = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
    one = np.ones(1, np.uint64)
    up, down = (np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return values, up, down


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys: prefix and suffix minima of blocks that wide."""
    n = len(keys) - width + 1
    rows = np.full(-(-len(keys) // width) * width, np.uint64((1 << 64) - 1))
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(raw: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``first, last`` suffix, place of the leading gram, and token of every piece of the texts that end at ``ends``."""
    values, up, down = _powers(SLICE + window)
    stop = np.repeat(ends, np.diff(ends, prepend=0))  # of each byte the end of its text
    low = np.uint64(2 * SLICE - 1)
    found = []
    for at in range(0, max(0, len(raw) - window + 1), SLICE):
        part = raw[at : at + SLICE + window - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * down[: len(part)], out=sums[1:])
        hashes = _mixed((sums[gram:] - sums[:-gram]) * up[: len(part) - gram + 1])
        lead = _least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
        own = stop[at : at + len(lead)]
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.minimum(np.append(first[1:], len(lead)) - 1, own[first] - window - at)
        first, last = first[last >= first], last[last >= first]
        anchor = (lead[first] & low).astype(np.int64)
        found.append((first + at, last + at, anchor + at, _mixed(hashes[anchor] + np.uint64(_BASE))))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (*np.empty((3, 0), np.int64), np.empty(0, np.uint64))


class Block:
    """Some documents, ordered by id and text, as one run of bytes."""

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        self.ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(rows)))
        self.raw = b"".join(self.texts)

    def index(self, window: int, gram: int) -> Block:
        """Find the pieces, and their distinct kinds in order of token and digest (whose low bit says: more than once)."""
        self.first, self.last, anchor, token = pieces(np.frombuffer(self.raw, np.uint8), self.ends, window, gram)
        self.back = anchor - self.first
        view, n = memoryview(self.raw), len(self.first)
        ranges = zip(self.first.tolist(), (self.last + window).tolist(), self.back.tolist(), strict=True)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], d) for a, b, d in ranges), np.uint64, n) & ~np.uint64(1)
        by = np.lexsort((digest, token))
        token, digest = token[by], digest[by]
        new = np.ones(n, bool)
        new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
        kind = np.cumsum(new) - 1
        self.place = by[new]  # a piece of each kind
        self.kind = np.empty(n, np.int64)
        self.kind[by] = kind
        self.token = token[new]
        self.digest = digest[new] | (np.bincount(kind, minlength=len(self.token)) > 1).astype(np.uint64) if n else digest
        return self


def _owned(token: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners of sorted tokens, and where each one's begin."""
    return np.unique((token >> np.uint64(64 - bits)).astype(np.int64), return_index=True)


def judge(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each block's (tokens, digests) those with a partner: place << 2, with _WHOLE and _OPEN."""
    token, digest = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.uint64)
    sizes = [p.shape[1] for p in parts]
    many = (digest & np.uint64(1)).astype(bool)
    digest = digest & ~np.uint64(1)
    by = np.lexsort((digest, token))
    token, digest = token[by], digest[by]
    led = np.ones(len(by), bool)
    led[1:] = token[1:] != token[:-1]
    new = led.copy()
    new[1:] |= digest[1:] != digest[:-1]
    kind, group = np.cumsum(new) - 1, np.cumsum(led) - 1
    whole = np.bincount(kind, 1 + many[by])[kind] > 1 if len(by) else many
    kinds = np.bincount(group[new]) if len(by) else group
    flags = _WHOLE * whole + _OPEN * (new & (kinds[group] > 1))
    back = np.empty(len(by), np.int64)
    back[by] = flags
    return [np.flatnonzero(f) << 2 | f[f > 0] for f in np.split(back, np.cumsum(sizes)[:-1])]


def multikey(raw: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by group and bytes, and whether each ties with the one before for ``window`` bytes."""
    order = np.argsort(group, kind="stable")
    ties = np.zeros(len(order), bool)
    ties[1:] = group[order][1:] == group[order][:-1]
    for depth in (*range(0, window - 7, 8), *([window - 8] if window % 8 else [])):
        open_ = ties.copy()
        open_[:-1] |= ties[1:]
        left = np.flatnonzero(open_)
        if not len(left):
            break
        word = np.ascontiguousarray(raw[at[order[left]][:, None] + np.arange(depth, depth + 8)]).view(">u8").ravel().astype(np.uint64)
        segment = np.cumsum(~ties[left])
        by = np.lexsort((word, segment))
        order[left], word = order[left][by], word[by]
        ties[left[1:]] = (segment[1:] == segment[:-1]) & (word[1:] == word[:-1])
    return order, ties


OPENED = "block int, at int, token long, back int, n int, alone boolean, bytes binary"
SORTED = "block int, marks binary, token long, d int, bytes binary, at int"


def remove_repeats(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed`` (intervals of bytes), ``kept`` (binary) of each row; ``window`` is 16 at least."""
    spark, gram = session(docs.sparkSession), window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(4 * least, -(-total // block_bytes))
    bits = max(least, total * 2 // gram // OWNER_PIECES).bit_length()
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def indexed(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table).index(window, gram)
        owners, at = _owned(block.token, bits)
        both = [np.stack(x).tobytes() for x in zip(np.split(block.token, at[1:]), np.split(block.digest, at[1:]), strict=True)] if len(owners) else []
        return pa.table({"owner": pa.array(owners, pa.int64()), "block": pa.array([key[0].as_py()] * len(owners), pa.int32()), "pieces": pa.array(both, pa.binary())})

    def judged(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column("block").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        found = judge([np.frombuffer(table.column("pieces")[i].as_py(), np.uint64).reshape(2, -1) for i in order])
        told = [(names[i], f.astype(np.uint32).tobytes()) for i, f in zip(order, found, strict=True) if len(f)]
        return pa.table({"block": pa.array([t[0] for t in told], pa.int32()), "owner": pa.array([key[0].as_py()] * len(told), pa.int64()), "flags": pa.array([t[1] for t in told], pa.binary())})

    def opened(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        """A row of the bytes that whole pieces cover, and a row for each opened piece."""
        schema = pa.schema([("block", pa.int32()), ("at", pa.int32()), ("token", pa.int64()), ("back", pa.int32()), ("n", pa.int32()), ("alone", pa.bool_()), ("bytes", pa.binary())])
        if not len(answers):
            return schema.empty_table()
        block = Block(texts).index(window, gram)
        begin = dict(zip(*map(np.ndarray.tolist, _owned(block.token, bits)), strict=True))
        status = np.zeros(len(block.token), np.int8)
        for owner, flags in zip(answers.column("owner").to_pylist(), answers.column("flags").to_pylist(), strict=True):
            told = np.frombuffer(flags, np.uint32)
            status[begin[owner] + (told >> 2)] = told & 3
        whole = np.flatnonzero(status[block.kind] & _WHOLE)
        whole = whole[np.argsort(block.first[whole])]
        spans = np.stack([block.first[whole], block.last[whole] + window], 1)
        if len(spans):  # those that meet become one; a document's end stays an end, as its last suffix ends there
            apart = np.flatnonzero(spans[1:, 0] > spans[:-1, 1])
            spans = np.stack([spans[np.append(0, apart + 1), 0], spans[np.append(apart, len(spans) - 1), 1]], 1)
        kinds = np.flatnonzero(status & _OPEN)
        place = block.place[kinds]
        first, last = block.first[place], block.last[place]
        data = [spans.astype(np.int32).tobytes(), *(block.raw[a:b] for a, b in zip(first.tolist(), (last + window).tolist(), strict=True))]
        columns = [first, block.token[kinds].view(np.int64), block.back[place], last - first + 1, ~(status[kinds] & _WHOLE).astype(bool)]
        columns = [pa.array([None, *c.tolist()], schema.field(i + 1).type) for i, c in enumerate(columns)]
        return pa.table([pa.array([key[0].as_py()] * len(data), pa.int32()), *columns, pa.array(data, pa.binary())], schema=schema)

    sent = blocks.groupBy("block").applyInArrow(indexed, "owner long, block int, pieces binary")
    answers = sent.groupBy("owner").applyInArrow(judged, "block int, owner long, flags binary")
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    table = materialize(both.applyInArrow(opened, OPENED), "suffix-opened")

    loose = table.where("token is not null")
    splitters = _splitters(loose, window, least, bucket_suffixes)
    dealt = loose.mapInArrow(lambda batches: _dealt(batches, splitters, window), "bucket int, " + OPENED)
    marked = materialize(dealt.groupBy("bucket").applyInArrow(lambda t: _bucket(t, window, bucket_suffixes), SORTED), "suffix-sorted")

    edges = marked.where("token is not null")
    equal = edges.groupBy("token", "d", "bytes").agg(F.collect_set(F.struct("block", "at")).alias("places")).where(F.size("places") > 1)
    one = equal.select(F.explode("places").alias("p")).select("p.block", F.array("p.at").alias("ats"))
    spans = table.where("token is null").select("block", "bytes", F.lit(False).alias("points"))
    points = marked.where("marks is not null").select("block", F.col("marks").alias("bytes"), F.lit(True).alias("points"))
    crossed = one.mapInArrow(_packed, "block int, bytes binary").withColumn("points", F.lit(True))
    marks = spans.unionByName(points).unionByName(crossed)
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda t, m: _kept(t, m, window), schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [np.array(x, np.int32).tobytes() for x in b.column("ats").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(data, pa.binary())], names=["block", "bytes"])


def _splitters(loose: DataFrame, window: int, least: int, bucket_suffixes: int) -> list[tuple[int, int, bytes]]:
    """Sampled suffixes as (token, d, bytes), in order: one fewer than there are buckets."""
    one = loose.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("suffixes")).first()
    buckets = min(MOST_BUCKETS, max(least, -(-one["suffixes"] // bucket_suffixes)))
    # a bounded sample, by hash: it only places the cuts, which change no result
    every = max(1, one["rows"] // min(32 * buckets, MOST_SAMPLED))
    drawn = F.pmod(F.xxhash64("bytes", "back"), F.lit(every)) == 0
    at = F.pmod(F.hash("bytes"), F.col("n"))
    picked = loose.where(drawn).select("token", (F.col("back") - at).alias("d"), F.substring("bytes", at + 1, F.lit(window)).alias("bytes"))
    keys = sorted(((r["token"] % (1 << 64)), r["d"], bytes(r["bytes"])) for r in picked.collect())
    return [keys[len(keys) * k // buckets] for k in range(1, buckets)] if keys else []


def _dealt(batches: Iterator[pa.RecordBatch], splitters: list[tuple[int, int, bytes]], window: int) -> Iterator[pa.RecordBatch]:
    """Each piece with its bucket, cut where it meets a splitter of its own token."""
    tokens = np.array([s[0] for s in splitters], np.uint64)
    for batch in batches:
        own = batch.column("token").to_numpy(zero_copy_only=False).view(np.uint64)
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        cut = np.flatnonzero(low != high)
        easy = np.flatnonzero(low == high)
        schema = pa.schema([("bucket", pa.int32()), *zip(batch.schema.names, batch.schema.types, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(low[easy], pa.int32()), *(c.take(pa.array(easy)) for c in batch.columns)], schema=schema)
        out = []
        for r in batch.take(pa.array(cut)).to_pylist():
            token, salt, runs = r["token"] % (1 << 64), xxhash.xxh3_64_intdigest(r["bytes"]), []
            for j in range(r["n"]):
                key = token, r["back"] - j, r["bytes"][j : j + window]
                a, b = bisect_left(splitters, key), bisect_right(splitters, key)
                bucket = a + salt % (b - a + 1)  # of equal splitters any bucket between
                if runs and runs[-1][0] == bucket:
                    runs[-1][2] = j
                else:
                    runs.append([bucket, j, j])
            out += [r | {"bucket": k, "at": r["at"] + i, "back": r["back"] - i, "n": j - i + 1, "bytes": r["bytes"][i : j + window]} for k, i, j in runs]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _bucket(table: pa.Table, window: int, suffixes: int) -> pa.Table:
    """Marks of tied suffixes by block, and the bucket's first and last suffix; sorted class by class of about so many suffixes."""
    tokens = table.column("token").to_numpy().view(np.uint64)
    table = table.take(pa.array(np.argsort(tokens, kind="stable")))
    tokens, counts = np.sort(tokens), table.column("n").to_numpy().astype(np.int64)
    blocks, marks, edges, at = [], [], [], 0
    while at < len(tokens):
        stop = at + max(1, int(np.searchsorted(np.cumsum(counts[at:]), suffixes)))
        stop = int(np.searchsorted(tokens, tokens[min(stop, len(tokens)) - 1], "right"))  # never inside a token's class
        part = table.slice(at, stop - at)
        n, data = counts[at:stop], part.column("bytes").to_pylist()
        raw = np.frombuffer(b"".join(data), np.uint8)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sizes = n + window - 1
        place = np.repeat(np.cumsum(sizes) - sizes, n) + step
        d = np.repeat(part.column("back").to_numpy().astype(np.int64), n) - step
        group = np.cumsum(np.diff(tokens[at:stop], prepend=tokens[at]) != 0)
        order, ties = multikey(raw, place, np.repeat(group, n) * (window + 1) + d, window)
        tied = ties.copy()
        tied[:-1] |= ties[1:]
        piece = np.repeat(np.arange(len(n)), n)
        own, starts = part.column("block").to_numpy(), part.column("at").to_numpy()
        hit = order[tied & part.column("alone").to_numpy(zero_copy_only=False)[piece[order]]]
        blocks.append(own[piece[hit]])
        marks.append((starts[piece[hit]] + step[hit]).astype(np.int32))
        for s in (order[0],) * (at == 0) + (order[-1],) * (stop == len(tokens)):
            edges.append((int(own[piece[s]]), int(tokens[at:stop][piece[s]].view(np.int64)), int(d[s]), raw[place[s] : place[s] + window].tobytes(), int(starts[piece[s]] + step[s])))
        at = stop
    block, mark = np.concatenate(blocks), np.concatenate(marks)
    by = np.lexsort((mark, block))
    names, begin = np.unique(block[by], return_index=True)
    packed = [x.tobytes() for x in np.split(mark[by], begin[1:])] if len(names) else []
    none = [None] * len(names)
    block_, token_, d_, bytes_, at_ = zip(*edges, strict=True)
    return pa.table(
        [
            pa.array([*names.tolist(), *block_], pa.int32()), pa.array([*packed, *[None] * len(edges)], pa.binary()), pa.array([*none, *token_], pa.int64()),
            pa.array([*none, *d_], pa.int32()), pa.array([*none, *bytes_], pa.binary()), pa.array([*none, *at_], pa.int32()),
        ],
        names=["block", "marks", "token", "d", "bytes", "at"],
    )


def _kept(texts: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    """What the marks leave of each document."""
    block = Block(texts)
    depth = np.zeros(len(block.raw) + 1, np.int32)
    for data, points in zip(marks.column("bytes").to_pylist(), marks.column("points").to_pylist(), strict=True):
        found = np.frombuffer(data, np.int32)
        first, last = (found, found + window) if points else found.reshape(-1, 2).T
        np.add.at(depth, first, 1)
        np.add.at(depth, last, -1)
    gone = np.cumsum(depth[:-1]) > 0
    out, begin = {"n_removed": [], "removed": [], "kept": []}, 0
    for text, end in zip(block.texts, block.ends.tolist(), strict=True):
        own = gone[begin:end]
        begin, cut = end, []
        if own.any():
            cut = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
        out["n_removed"].append(sum(cut[1::2]) - sum(cut[::2]))
        out["removed"].append([{"start": a, "end": b} for a, b in zip(cut[::2], cut[1::2], strict=True)])
        out["kept"].append(b"".join(text[a:b] for a, b in zip([0, *cut[1::2]], [*cut[::2], len(text)], strict=True)))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    sizes = [len(t) for t in block.texts]
    return pa.table([pa.array(block.ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], span), pa.array(out["kept"], pa.binary())], names=["doc_id", "n_bytes", *out])
