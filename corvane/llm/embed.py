"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of their second moments, so
the first coordinates carry most of a product.  Vectors are dealt to groups
along the first axis, by hash where many share a coordinate; every pair of groups is a tile.  A tile multiplies the
leading coordinates first; what the rest can add is at most the product of the
two suffix norms, so a pair that cannot reach the threshold any more stops
there, and the next coordinates are added for the others.  What survives is
decided by the cosine in double precision on the vectors as given.  A pair of
groups whose boxes in the leading coordinates are too far apart for any link is
not compared at all.

Equal vectors form one class, counted with its size, so a vector that many rows
share costs one row.  A tile returns, for each vector, how many vectors it
links to and a spanning forest of the links, never the links themselves.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths are never compared; a null id links with
nothing; rows that repeat an id count as vectors of their own; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import BROADCAST_BYTES, materialize, range_cuts, session
from corvane.llm.graph import components

#: Vectors in a group at most (on average), and groups at least.
GROUP, LEAST_GROUPS = 8192, 8
LEADING = 16
BOX = 8
_STRIPE = 1024
#: Slack of single precision in the bounds.
_SLACK = 2e-4


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The principal axes as columns, most energy first.  Sums are made by task; the driver gets dim * dim numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), dim))
                total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = classes.select("vector").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim, dim))
    for r in sums:
        total[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b`` in ``labels`` (each node's label is a node with a label no greater)."""
    while True:
        la, lb = labels[a], labels[b]
        if (same := la == lb).all():
            return
        a, b = a[~same], b[~same]
        low = np.minimum(la, lb)[~same]
        np.minimum.at(labels, la[~same], low)
        np.minimum.at(labels, lb[~same], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def tile_links(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) with cosine at ``threshold`` or more; i < j if both are one group."""
    ux, uy = _unit(x), _unit(y)
    rx, ry = (ux @ rotation).astype(np.float32), (uy @ rotation).astype(np.float32)
    dim = x.shape[1]
    lead = min(LEADING, dim)

    def suffix(r: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((r[:, k:] ** 2).sum(axis=1))

    sx, sy = suffix(rx, lead), suffix(ry, lead)
    mid = min(dim, 2 * lead)
    mx, my = suffix(rx, mid), suffix(ry, mid)
    for at in range(0, len(x), _STRIPE):
        stripe = slice(at, at + _STRIPE)
        from_ = at if same else 0
        partial = rx[stripe, :lead] @ ry[from_:, :lead].T
        bound = sx[stripe, None] * sy[None, from_:]
        bound += partial
        i, j = np.nonzero(bound >= threshold - _SLACK)
        for part in range(0, len(i), 1 << 19):
            pi, pj = i[part : part + (1 << 19)], j[part : part + (1 << 19)]
            dots = partial[pi, pj]
            pi, pj = pi + at, pj + from_
            if same:
                keep = pi < pj
                pi, pj, dots = pi[keep], pj[keep], dots[keep]
            dots = dots + np.einsum("ij,ij->i", rx[pi, lead:mid], ry[pj, lead:mid])
            keep = dots + mx[pi] * my[pj] >= threshold - _SLACK
            pi, pj = pi[keep], pj[keep]
            exact = np.einsum("ij,ij->i", ux[pi], uy[pj])
            keep = exact >= threshold
            yield pi[keep], pj[keep]


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row; links hold from cosine ``threshold`` on."""
    session(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0))
    classes = materialize(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    members = materialize(usable.join(classes, "vector").select("vec_id", "rep", "n"), "vector-members")
    found = None
    for dim in [r[0] for r in classes.select(F.size("vector")).distinct().collect()]:
        part = _links(classes.where(F.size("vector") == dim), dim, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "tile-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b is not null").select("a", "b"), name="vector-components").withColumnRenamed("node", "rep")
    of_class = materialize(classes.select("rep", "n").join(counts, "rep", "left").join(joined, "rep", "left").select("rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "class-links")
    linked = members.select("vec_id", "rep").join(of_class, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tiles(grouped: DataFrame, box: int, reach: float) -> DataFrame:
    """``x, y, group``: the pairs of groups to compare (x <= y), once for each of the two.

    Unit vectors with a cosine of c are sqrt(2 - 2c) apart; boxes farther apart
    than the square root of ``reach`` hold no link.  Groups meet by the cells of
    that width that they touch on the first axis, so this is an equi-join.
    """
    sides = [f(F.col("lead")[k]).alias(f"{f.__name__}{k}") for k in range(box) for f in (F.min, F.max)]
    boxes = materialize(grouped.groupBy("group").agg(*sides), "boxes")
    width = max(math.sqrt(reach), 1e-3)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    left = boxes.select(cells(F.col("min0"), F.col("max0")).alias("cell"), *[F.col(c).alias(f"{c}_x") for c in boxes.columns])
    right = boxes.select(cells(F.col("min0") - width, F.col("max0") + width).alias("cell"), *[F.col(c).alias(f"{c}_y") for c in boxes.columns])
    gaps = [F.greatest(F.lit(0.0), F.col(f"min{k}_x") - F.col(f"max{k}_y"), F.col(f"min{k}_y") - F.col(f"max{k}_x")) for k in range(box)]
    near = left.join(right, "cell").where((F.col("group_x") <= F.col("group_y")) & (sum((g * g for g in gaps), F.lit(0.0)) <= reach))
    pairs = near.select(F.col("group_x").alias("x"), F.col("group_y").alias("y")).distinct()
    return materialize(pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("group")), "tiles")


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``a, b, n``: forest edges (a, b, 0) and link counts (a, null, n) of the classes, by tile."""
    rotation = axes(classes, dim)
    box = min(BOX, dim)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = _unit(_matrix(batch.column(0), dim)) @ rotation[:, :box]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lead), pa.list_(pa.float64()))], names=["vector", "rep", "n", "lead"])

    at = materialize(classes.select("vector", "rep", "n").mapInArrow(placed, "vector array<double>, rep long, n long, lead array<double>"), "placed")
    total = at.count()
    groups = max(LEAST_GROUPS, -(-total // GROUP))
    size = max(1, -(-total // groups))
    found = range_cuts(at.select(F.col("lead")[0].alias("value"), F.lit(1).cast("long").alias("weight")), size)
    # a coordinate that many vectors share is a range of its own, dealt to several groups
    cuts = np.array([r["cut"] for r in found])
    first = np.concatenate([[0], np.cumsum([-(-r["weight"] // size) if r["own"] else 1 for r in found] + [1])]).astype(np.int64)

    @F.arrow_udf("long")
    def group_of(lead: pa.Array, salt: pa.Array) -> pa.Array:
        k = np.searchsorted(cuts, lead.to_numpy(zero_copy_only=False), "left")
        return pa.array(first[k] + salt.to_numpy(zero_copy_only=False) % (first[k + 1] - first[k]), pa.int64())

    grouped = materialize(at.withColumn("group", group_of(F.col("lead")[0], F.pmod(F.hash("rep"), F.lit(1 << 20)))), "grouped")
    tiles = _tiles(grouped, box, 2 - 2 * threshold + 1e-9)
    if tiles.count() * 64 <= BROADCAST_BYTES:
        tiles = F.broadcast(tiles)
    dealt = grouped.join(tiles, "group").select("vector", "rep", "n", "group", "x", "y")

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        x, rep, n = _matrix(table.column("vector"), dim), table.column("rep").to_numpy(), table.column("n").to_numpy()
        group = table.column("group").to_numpy()
        left, right = np.flatnonzero(group == a), np.flatnonzero(group == b)
        links, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in tile_links(x[left], x[right], rotation, threshold, a == b):
            p, q = left[i], right[j]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            _forest(labels, p, q)
        some, tied = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(rep)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([rep[some], rep[tied]]), pa.int64()),
                "b": pa.array(np.concatenate([rep[some], rep[labels[tied]]]), pa.int64(), mask=np.arange(len(some) + len(tied)) < len(some)),
                "n": pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]), pa.int64()),
            }
        )

    return dealt.groupBy("x", "y").applyInArrow(compared, "a long, b long, n long")
