"""Merkle manifest of a dataset, and proofs for many leaves at once (Octopus multiproof).

A leaf is the digest of a row's fields.  The leaves of one ``tree`` value, in
order, are numbered without gaps; every ``ARITY`` consecutive nodes (the last run
may have fewer, even one) have their digest above them until one node remains.
The roots of the trees, in order of their names, are the leaves of a last tree,
whose root stands for the dataset.  Digests are lowercase hex of sha256 and are
hashed as that text.

* Numbers come from a range partitioning by name and order: a partition counts
  its rows by tree, and what stands before a partition is a sum over partitions.
  A tree that holds most rows is spread over many partitions.
* ``ARITY ** LEVELS`` consecutive leaves of a tree are a *leaf partition*; its
  interior is derived inside one task, which sends up its top node alone.
* To prove its leaves, a leaf partition computes the least union of coordinates
  (level, number) that its leaves do not determine (:func:`missing`), fetches
  them by one join, derives the interiors that the proofs share, and expands each
  leaf's own proof locally.  Nodes high in a tree, which very many partitions
  ask for, are copied by a salt.

Nulls: a null field hashes as ``-``; null tree names form a tree that comes
first; null ids come last.  Rows that repeat an id are leaves of their own,
ordered by digest, and equal rows are interchangeable.  A text of any length is hashed where it is read and
does not move.  An empty table has no root and no proofs.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import materialize, session

#: Nodes under one, levels inside a leaf partition, and leaves a partition of the numbering.
ARITY, LEVELS, RANGE_LEAVES = 8, 4, 1 << 19
#: Copies of a node that stands at least twice ``LEVELS`` levels up.
COPIES = 64

_PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def height(size: Column) -> Column:
    """Levels above the leaves: how many octal digits the last leaf's number has, none for a lone leaf."""
    return F.when(size <= 1, 0).otherwise(F.length(F.conv((size - 1).cast("string"), 10, ARITY))).cast("int")


def tree_name(value: Column) -> Column:
    """A name that sorts like ``value``, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``number``, from 0 in each ``tree`` by ``order``, and ``size``, the tree's rows; read the result more than once freely."""
    rows = materialize(rows, "merkle-leaves")  # else the range partitioning's sample would hash all texts once more
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_LEAVES))
    by = [F.col("tree"), *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "merkle-sorted")
    # a row for each tree of each partition: as many as partitions and trees
    runs = placed.groupBy("_part", "tree").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("tree")
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", "tree", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("size"))
    found = placed.join(materialize(runs, "merkle-runs"), ["_part", "tree"])
    return found.withColumn("number", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def climb(nodes: list[str], total: int, levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them; ``total``: the whole tree's nodes on the lowest, one of them ends the climb."""
    out = [nodes]
    while total > 1 and len(out) <= levels:
        last = out[-1]
        out.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
        total = -(-total // ARITY)
    return out


def missing(numbers: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The least union of coordinates (level, number) that proofs of the leaves ``numbers`` need and they do not determine."""
    level, known, out = 0, sorted(set(numbers)), []
    while size > 1:
        have = set(known)
        parents = sorted({k // ARITY for k in known})
        out += [(level, c) for p in parents for c in range(p * ARITY, min(size, (p + 1) * ARITY)) if c not in have]
        level, known, size = level + 1, parents, -(-size // ARITY)
    return out


def expand(leaves: dict[int, str], fetched: dict[tuple[int, int], str], size: int) -> dict[int, list[tuple[str, str]]]:
    """Of each leaf, level by level, what stands before and after its node in its run; interiors are derived once."""
    nodes, known, level, paths = dict(fetched), sorted(leaves), 0, {k: [] for k in leaves}
    nodes.update(((0, k), d) for k, d in leaves.items())
    sides: list[dict[int, tuple[str, str]]] = []
    while size > 1:
        beside, parents = {}, sorted({k // ARITY for k in known})
        for p in parents:
            run = [nodes[level, c] for c in range(p * ARITY, min(size, (p + 1) * ARITY))]
            nodes[level + 1, p] = digest("".join(run))
            for c in range(len(run)):
                beside[p * ARITY + c] = "".join(run[:c]), "".join(run[c + 1 :])
        sides.append(beside)
        level, known, size = level + 1, parents, -(-size // ARITY)
    for k, path in paths.items():
        at = k
        for beside in sides:
            path.append(beside[at])
            at //= ARITY
    return paths


def fold(claim: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that follows from a leaf's digest and its siblings."""
    for before, after in path:
        claim = digest(before + claim + after)
    return claim


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, number, size, leaf and what came with it) and ``nodes`` (tree, level, number, size, digest): the top nodes of leaf partitions and all above them."""

    leaves: DataFrame
    nodes: DataFrame
    levels: int = LEVELS

    @classmethod
    def of(cls, rows: DataFrame, *order: Column, interior: bool = False, levels: int = LEVELS) -> Manifest:
        """Number ``rows`` (tree, leaf, ...) and derive the nodes; ``interior``: those inside leaf partitions too, to prove a few leaves later."""
        leaves = numbered(rows, *order)
        block = F.floor(F.col("number") / ARITY**levels)

        def inside(key: tuple, table: pa.Table) -> pa.Table:
            tree, at, size = key[0].as_py(), key[1].as_py(), table.column("size")[0].as_py()
            table = table.sort_by("number")
            climbed = climb(table.column("leaf").to_pylist(), size, levels)
            wanted = [(k, i, d) for k, nodes in enumerate(climbed) if interior or k == len(climbed) - 1 for i, d in enumerate(nodes, at * ARITY ** (levels - k))]
            n = len(wanted)
            level, number, found = zip(*wanted, strict=True)
            return pa.table({"tree": [tree] * n, "level": pa.array(level, pa.int32()), "number": pa.array(number, pa.int64()), "size": pa.array([size] * n, pa.int64()), "digest": found})

        schema = "tree string, level int, number long, size long, digest string"
        nodes = materialize(leaves.select("tree", block.alias("block"), "number", "size", "leaf").groupBy("tree", "block").applyInArrow(inside, schema), "merkle-tops")
        highest = leaves.agg(F.max(height(F.col("size")))).first()[0] or 0
        level, above = nodes.where(F.col("level") == levels), []
        for k in range(levels, highest):  # trees shrink to an eighth with each level; there are some tens at most
            run = F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda n: n["digest"])
            level = level.where(height(F.col("size")) > k).groupBy("tree", F.floor(F.col("number") / ARITY).alias("number"), "size").agg(F.sha2(F.array_join(run, "").cast("binary"), 256).alias("digest"))
            level = materialize(level.select("tree", F.lit(k + 1).alias("level"), "number", "size", "digest"), "merkle-level")
            above.append(level)
        for one in above:
            nodes = nodes.unionByName(one)
        return cls(leaves, nodes, levels)

    def roots(self) -> DataFrame:
        """``tree, leaf``: each tree's root."""
        return self.nodes.where(F.col("level") == height(F.col("size"))).select("tree", F.col("digest").alias("leaf"))

    def prove(self, wanted: DataFrame | None = None, *, claim: str = "leaf", keep: Sequence[str] = (), beyond: DataFrame | None = None, with_path: bool = False) -> DataFrame:
        """``tree, number, keep, subroot, proof_sha256, folded_root`` (and ``path``) of ``wanted`` rows of ``leaves`` (all).

        ``claim`` names the digest to fold.  ``beyond`` (tree, subroot, path)
        goes on from a tree's root.
        """
        rows = self.leaves if wanted is None else wanted
        rows = rows.select("tree", "number", "size", F.col("leaf").alias("_leaf"), F.col(claim).alias("_claim"), *keep, F.floor(F.col("number") / ARITY**self.levels).alias("block"))
        if beyond is None:
            beyond = self.roots().select("tree", F.col("leaf").alias("subroot"), F.array().cast(_PATH).alias("path"))

        def lacking(key: tuple, table: pa.Table) -> pa.Table:
            found = missing(table.column("number").to_pylist(), table.column("size")[0].as_py())
            return pa.table({"tree": [key[0].as_py()] * len(found), "block": pa.array([key[1].as_py()] * len(found), pa.int64()), "level": pa.array([f[0] for f in found], pa.int32()), "number": pa.array([f[1] for f in found], pa.int64())}, schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("number", pa.int64())]))

        parts = rows.select("tree", "block", "number", "size").groupBy("tree", "block")
        asked = parts.applyInArrow(lacking, "tree string, block long, level int, number long")
        high = F.col("level") >= 2 * self.levels
        asked = asked.withColumn("copy", F.when(high, F.pmod("block", F.lit(COPIES))).otherwise(0).cast("int"))
        copied = self.nodes.withColumn("copy", F.explode(F.when(high, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))))
        none = F.lit(None)
        fetched = asked.join(copied, ["tree", "level", "number", "copy"]).select("tree", "block", "level", "number", "digest", none.cast(_PATH).alias("path"))
        rest = rows.select("tree", "block").distinct().join(beyond, "tree").select("tree", "block", F.lit(-1).alias("level"), none.cast("long").alias("number"), F.col("subroot").alias("digest"), "path")

        kept = rows.select(*keep).schema
        out = f"tree string, number long, {''.join(f'{f.name} {f.dataType.simpleString()}, ' for f in kept)}subroot string, proof_sha256 string, folded_root string" + (f", path {_PATH}" if with_path else "")

        def expanded(leaves: pa.Table, found: pa.Table) -> pa.Table:
            size = leaves.column("size")[0].as_py()
            nodes, subroot, tail = {}, None, []
            for f in found.to_pylist():
                if f["level"] < 0:
                    subroot, tail = f["digest"], [(p["before"], p["after"]) for p in f["path"]]
                else:
                    nodes[f["level"], f["number"]] = f["digest"]
            numbers = leaves.column("number").to_pylist()
            paths = expand(dict(zip(numbers, leaves.column("_leaf").to_pylist(), strict=True)), nodes, size)
            proofs = [[*paths[k], *tail] for k in numbers]
            columns = {"tree": leaves.column("tree"), "number": leaves.column("number"), **{c: leaves.column(c) for c in keep}}
            columns["subroot"] = pa.array([subroot] * len(numbers), pa.string())
            columns["proof_sha256"] = pa.array([digest("".join(side for pair in p for side in pair)) for p in proofs], pa.string())
            columns["folded_root"] = pa.array([fold(c, p) for c, p in zip(leaves.column("_claim").to_pylist(), proofs, strict=True)], pa.string())
            if with_path:
                pair = pa.struct([("before", pa.string()), ("after", pa.string())])
                columns["path"] = pa.array([[{"before": b, "after": a} for b, a in p] for p in proofs], pa.list_(pair))
            return pa.table(columns)

        return rows.groupBy("tree", "block").cogroup(fetched.unionByName(rest).groupBy("tree", "block")).applyInArrow(expanded, out)


def verify(rows: DataFrame, *order: Column, keep: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """Every row of ``rows`` (tree, leaf, claim, ``keep``) proved to the dataset's root.

    Returns ``keep, leaf, subroot, root, proof_sha256, folded_root`` (from the
    claim and the leaf's siblings) and ``verified``.
    """
    session(rows.sparkSession)
    each = Manifest.of(rows, *order, levels=levels)
    last = Manifest.of(each.roots().select(F.lit("").alias("tree"), "leaf", F.col("tree").alias("name")), F.col("name"), levels=levels)
    found = last.roots().first()
    root = F.lit(found["leaf"] if found else None).cast("string")
    beyond = last.prove(keep=("name", "leaf"), with_path=True).select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "path")
    proved = each.prove(claim="claim", keep=(*keep, "leaf"), beyond=materialize(beyond, "merkle-last"))
    return proved.select(*keep, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
