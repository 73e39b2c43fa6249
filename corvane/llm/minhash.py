"""MinHash near-dedup with b-bit signatures.

A document's set is its distinct five-word shingles (ASCII letters lower-cased);
with fewer words, the whole sequence is the one shingle.  128 minima are taken;
32 bands of four make candidates, and the lowest four bits of each minimum,
packed into 64 bytes, estimate a candidate's similarity by counting equal
groups of bits, corrected for chance collisions.  Candidates whose estimate is
far below the threshold go; the rest are confirmed on full sets, so a link is
exact.  A pair at similarity 0.75 misses all bands with odds of 5e-6.

Documents with equal word sequences form one class first, whose least id stands
for it.  No row is ever made for each pair of a bucket.  Each class is compared
with one hub, the least class that shares any bucket with it, and the links
found this way are joined to components.  What is still open are buckets whose
members lie in different components.  They are cut into tiles of bounded size
and compared inside tasks, twice: by signature, which leaves the members that
may have a link to another component, and then by these members' full sets,
of which a tile returns a spanning forest of the components that it joins.  A
bucket of pairs just below the threshold thus costs the square of its size in
comparisons inside tasks, but rows in proportion to its size (to its square
over ``TILE``, once it is larger than a tile).

Null or empty texts have an empty set and link with nothing; a null id links
with nothing and counts as kept; rows that repeat an id count as one document; of
equal texts the least id stands for all; a very long text is read whole, in the
task that holds its row, and its set moves only if it is a candidate;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.bpe import Memo
from corvane.llm.common import anti, fresh, materialize, semi, session
from corvane.llm.graph import components, merge

SHINGLE, BANDS, ROWS, BITS = 5, 32, 4, 4
MINIMA = BANDS * ROWS
#: Candidates are kept down to this far below the threshold: 4.5 standard deviations of the estimate.
SLACK = 0.18
#: Members of a tile's side, and shingles of all of them together, on average at most.
TILE, TILE_SHINGLES = 2048, 1 << 20
_WORDS = MINIMA * BITS // 64


@lru_cache(maxsize=1)
def _hasher() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 300_000)


@lru_cache(maxsize=1)
def _random() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return odd(SHINGLE), odd(MINIMA)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a document's shingles."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hasher().__getitem__, words), np.uint64, n)
    factors = _random()[0]
    if n < SHINGLE:
        return _mix(np.array([(hashes * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = hashes[: n - SHINGLE + 1] * factors[0]
    for i in range(1, SHINGLE):
        out += hashes[i : n - SHINGLE + 1 + i] * factors[i]
    return np.unique(_mix(out))


def _minima(hashes: np.ndarray) -> np.ndarray:
    factors = _random()[1]
    minima = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    step = (1 << 17) // MINIMA
    for at in range(0, len(hashes), step):
        np.minimum(minima, (hashes[None, at : at + step] * factors[:, None]).min(axis=1), out=minima)
    return _mix(minima)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bands' hashes and the packed low bits of a non-empty set's minima."""
    minima = _minima(hashes)
    bands = minima.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    low = (minima >> np.uint64(20)).astype(np.uint8) & 15
    return keys.view(np.int64), (low[0::2] | low[1::2] << 4).tobytes()


def sign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, sequence`` (a 128-bit digest of the words), ``bands, bits`` of each row."""
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.only(_hasher())
        for batch in batches:
            n, seq, bands, bits = [], [], [], []
            for text in batch.column(1):
                words = text.as_py().lower().split()
                hashes = shingle_hashes(words)
                n.append(len(hashes))
                seq.append(hashlib.sha256(b" ".join(words)).digest()[:16] if len(hashes) else None)
                keys, packed = signature(hashes) if len(hashes) else (None, None)
                bands.append(keys)
                bits.append(None if packed is None else np.frombuffer(packed, "<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sequence", "bands", "bits"],
            )
        Memo.only()  # word hashes are cheap to make again; an idle worker holds none

    return rows.mapInArrow(run, "doc_id long, n_shingles long, sequence binary, bands array<long>, bits array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: equal groups of bits, corrected for chance."""
    nibble = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for k in range(_WORDS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(nibble))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(MINIMA)) - chance) / (1 - chance)


def shingle_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shingles`` (array of 64-bit hashes) of each row."""
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.only(_hasher())
        for batch in batches:
            sets = [shingle_hashes(x.as_py().lower().split()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])
        Memo.only()

    return rows.mapInArrow(run, "doc_id long, shingles array<long>")


def _sets_of(ids: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """``doc_id, shingles`` of the documents in ``ids``, one row each."""
    ids = materialize(ids.distinct(), f"{name}-ids")
    return materialize(shingle_sets(semi(texts, ids, "doc_id")).dropDuplicates(["doc_id"]), f"{name}-sets")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold; ``a`` may repeat without bound."""
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts, "star")
    sides = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return sides.withColumn("both", both).where((F.col("both") * 100) >= (F.size("x") + F.size("y") - F.col("both")) * percent).select("a", "b")


@dataclass
class Tile:
    """Members of one bucket that are compared in one task, each with each of another component."""

    band: int
    x: int
    y: int
    chunk: np.ndarray
    rep: np.ndarray
    component: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    rest: list  # what else a member has: bands, or sets

    def candidates(self, left: slice, percent: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (i in ``left``, j > i) in different components whose sizes and signatures allow a link."""
        at = left.start
        n, m = self.n[left, None], self.n[None, at:]
        ok = (self.component[left, None] != self.component[None, at:]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        if self.x != self.y:
            ok &= self.chunk[left, None] != self.chunk[None, at:]
        i, j = np.nonzero(ok)
        later = i < j
        i, j = i[later] + at, j[later] + at
        differ = self.bits[i] ^ self.bits[j]
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        equal = 1 - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) / MINIMA
        alike = (equal - 2.0**-BITS) / (1 - 2.0**-BITS) >= floor
        return i[alike], j[alike]

    def hopeful(self, percent: int, floor: float) -> np.ndarray:
        """Which members have a candidate whose first shared bucket this is."""
        found, bands = np.zeros(len(self.rep), bool), np.array(self.rest)
        for at in range(0, len(found), 64):
            i, j = self.candidates(slice(at, at + 64), percent, floor)
            shared = bands[i] == bands[j]
            here = bands[i, shared.argmax(axis=1)] == self.band
            found[i[here]] = found[j[here]] = True
        return found

    def forest(self, percent: int, floor: float) -> list[tuple[int, int]]:
        """Links that join the members' components, no more of them than components less one."""
        lens = np.fromiter(map(len, self.rest), np.int64, len(self.rest))
        _, flat = np.unique(np.concatenate(self.rest), return_inverse=True)
        starts = np.cumsum(lens) - lens
        sets = np.split(flat, starts[1:])
        held, links = np.zeros(int(flat.max(initial=0)) + 1, bool), []
        for k in range(len(lens)):
            _, others = self.candidates(slice(k, k + 1), percent, floor)
            if not len(others):
                continue
            held[sets[k]] = True
            if 2 * lens[others].sum() > len(flat):
                both = np.add.reduceat(held[flat], starts, dtype=np.int64)[others]
            else:
                both = np.fromiter((np.count_nonzero(held[sets[j]]) for j in others), np.int64, len(others))
            held[sets[k]] = False
            for j in others[both * 100 >= (lens[k] + lens[others] - both) * percent]:
                a, b = self.component[k], self.component[j]
                if a != b:
                    self.component[self.component == max(a, b)] = min(a, b)
                    links.append((int(self.rep[k]), int(self.rep[j])))
        return links


_TILE = "band long, x int, y int, chunk int, rep long, component long, n_shingles long, bits array<long>"


def _tiles(batches: Iterator[pa.RecordBatch], wide: int | None) -> Iterator[Tile]:
    """The tiles in rows of ``_TILE`` and one more array, sorted by ``band, x, y``; ``wide``: that array's fixed length."""

    def numbers(batch: pa.RecordBatch) -> list:
        plain = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        bits = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
        flat = batch.column(8).flatten().to_numpy()
        if wide:
            return [*plain, bits, flat.reshape(-1, wide)]
        return [*plain, bits, np.split(flat, np.cumsum(pc.list_value_length(batch.column(8)).to_numpy(zero_copy_only=False))[:-1])]

    def tile(parts: list[list]) -> Tile:
        first = parts[0]
        columns = first if len(parts) == 1 else [np.concatenate(c) if k < 8 or wide else list(chain.from_iterable(c)) for k, c in enumerate(zip(*parts, strict=True))]
        return Tile(int(first[0][0]), int(first[1][0]), int(first[2][0]), *columns[3:5], columns[5].copy(), *columns[6:])

    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = numbers(batch)
        new = np.zeros(batch.num_rows, bool)
        for c in columns[:3]:
            new[1:] |= c[1:] != c[:-1]
        if held and any(c[0] != h[0] for c, h in zip(columns[:3], held[0][:3], strict=True)):
            yield tile(held)
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in pairwise(edges):
            held.append([c[a:b] for c in columns])
            if b < batch.num_rows:
                yield tile(held)
                held = []
    if held:
        yield tile(held)


def _sorted_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")


def _across(shared: DataFrame, joined: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join the components of ``joined`` wherever members of a bucket link across them."""
    floor = percent / 100 - SLACK
    spread = shared.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    spread = materialize(spread, "spread")
    mixed = spread.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("lo <> hi")
    mixed = materialize(mixed.select("band", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") / TILE_SHINGLES)).cast("int").alias("chunks")), "open-buckets")
    open_ = spread.join(mixed, "band").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    open_ = open_.join(reps.select("rep", "bits", "bands"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = open_.select("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "rep", "component", "n_shingles", "bits", "bands")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches, BANDS):
            if len(at := np.flatnonzero(t.hopeful(percent, floor))):
                same = [pa.array([v] * len(at), kind) for v, kind in ((t.band, pa.int64()), (t.x, pa.int32()), (t.y, pa.int32()))]
                bits = pa.array(list(t.bits[at].view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*same, pa.array(t.chunk[at]), *[pa.array(c[at]) for c in (t.rep, t.component, t.n)], bits], names=["band", "x", "y", "chunk", "rep", "component", "n_shingles", "bits"])

    some = materialize(_sorted_tiles(dealt).mapInArrow(hopeful, _TILE), "hopeful")
    sets = _sets_of(some.select(F.col("rep").alias("doc_id")), texts, "hopeful").withColumnRenamed("doc_id", "rep")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches, None):
            if links := t.forest(percent, floor):
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])

    columns = [c.split()[0] for c in _TILE.split(", ")]
    return _sorted_tiles(some.join(sets, "rep").select(*columns, "shingles")).mapInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; links hold from ``percent`` of the union on."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(sign(texts), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("sequence").agg(F.min("doc_id").alias("rep")), "classes")
    members = materialize(usable.select("doc_id", "sequence").join(classes, "sequence").select("doc_id", "rep"), "members")
    reps = usable.join(classes.select(F.col("rep").alias("doc_id"), F.col("sequence").alias("_s")), "doc_id").where("sequence = _s")
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "bits").dropDuplicates(["rep"]), "representatives")

    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    hubs = materialize(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1").drop("n"), "hubs")
    shared = materialize(banded.join(hubs, "band"), "shared-bands")

    # one hub for each class: pairs in proportion to the classes, whatever the buckets hold
    light = lambda id_, n, bits: reps.select(F.col("rep").alias(id_), F.col("n_shingles").alias(n), F.col("bits").alias(bits))
    stars = shared.groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).where("a <> b")
    stars = stars.join(light("b", "nb", "xb"), "b").join(light("a", "na", "xa"), "a")
    plausible = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate("xa", "xb") >= percent / 100 - SLACK)
    tried = materialize(stars.where(plausible).select("a", "b"), "candidates")
    joined = components(materialize(_confirmed(tried, texts, percent), "links"))
    more = materialize(_across(shared.select("band", "rep", "n_shingles"), joined, reps, texts, percent), "tile-links")
    joined = merge(joined, more, name="all-components")

    of_class = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("_component"))
    of_doc = materialize(of_class.groupBy("doc_id").agg(F.min("_component").alias("_component")), "class-components")
    out = signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the least id."""
    found = near_duplicates(docs, percent=percent, id_col=id_col, text_col=text_col)
    key = fresh(docs, "_gone")
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(key)).distinct(), "not-kept")
    return anti(docs.withColumn(key, F.col(id_col).cast("long")), gone, key).select(docs.columns)
