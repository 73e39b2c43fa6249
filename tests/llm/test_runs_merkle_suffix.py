"""Periodic runs, the Merkle manifest and suffix-array dedup against plain versions; nulls, repeats, ties, long texts, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, periodic, suffix
from corvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def plain():
    docs = pd.read_parquet(f"{SF}/documents.parquet").astype(object)
    return [r for r in docs.where(docs.notna(), None).to_dict("records")]


# --- periodic runs ---


def runs_of(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs, by trying every period; of one stretch the smallest period alone."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, exponent * q) and not any(all(words[j] == words[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_in_random_words():
    rnd = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            n, letters = rnd.choice([0, 1, 2, 5, 6, 7, 20, 40, 90]), rnd.choice([1, 2, 2, 3, 10])
            words = [rnd.randrange(letters) for _ in range(n)]
            if n and rnd.random() < 0.7:
                p, a = rnd.randint(1, max(1, n // 3)), rnd.randrange(n)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        ends = np.cumsum(list(map(len, docs)))
        numbers = np.array([x + 100 * i for i, d in enumerate(docs) for x in d], np.int64)
        want = [(s + end - len(d), n, q) for d, end in zip(docs, ends.tolist(), strict=True) for s, n, q in runs_of(d)]
        assert list(map(tuple, periodic.find(numbers, ends).tolist())) == want


def test_op11(spark, plain):
    want = {}
    for r in plain:
        h = zlib.crc32(str(r["doc_id"]).encode())
        words, g = (r["text"] or "").encode().split(), h // 10
        n = len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = fast_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want[r["doc_id"]] = (
            len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
        )
    got = {r["doc_id"]: tuple(r)[1:-1] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == want and any(v[0] for v in want.values())


def fast_runs(words: list) -> list[tuple[int, int, int]]:
    """As :func:`runs_of`, each period compared at once."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-q] == w[q:]).view(np.int8), [0]])))
        for s, e in edge.reshape(-1, 2).tolist():
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e + q), q)  # the smallest period comes first
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_edge_cases(spark):
    long = "x y z " * 400_000 + "end"
    rows = [(1, None), (None, "a a a a a a"), (2, ""), (2, "a a a a a a b"), (2, "a a a a a a b"), (3, "  \t "), (4, long), (5, "a b a b a b a"), (6, "ä ä " * 6)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'n' AS n_words", "1 AS runs", "2 AS collapsed")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(
        [
            (1, 0, [], ""), (None, 6, [(0, 6, 1)], "a"), (2, 0, [], ""), (2, 7, [(0, 6, 1)], "a b"), (2, 7, [(0, 6, 1)], "a b"), (3, 0, [], ""),
            (4, 1_200_001, [(0, 1_200_000, 3)], "x y z end"), (5, 7, [], "a b a b a b a"), (6, 6, [(0, 6, 1)], "ä ä"),
        ],
        key=key,
    )
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# --- Merkle manifest ---


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def H(*x: str) -> str:
    return sha("".join(x).encode())


def levels_over(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proofs(rows: list[dict]) -> list[tuple]:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` by whole trees."""
    by: dict = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    fields = ("doc_id", "source", "lang", "n_chars")
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, H(*(field(r[c]) for c in (*fields, "text")))))
        trees[name] = levels_over([H(*(field(r[c]) for c in (*fields, "text"))) for r in by[name]])
    top, out = levels_over([trees[n][-1][0] for n in names]), []
    for nth, name in enumerate(names):
        for i, r in enumerate(by[name]):
            leaf, beside = trees[name][0][i], []
            claim = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                claim = H(*(field(r[c]) for c in fields), field(text))
            for tree, k in ((trees[name], i), (top, nth)):
                for level in tree[:-1]:
                    run = level[k // 8 * 8 :][:8]
                    beside += run[: k % 8] + run[k % 8 + 1 :]
                    claim = H(*run[: k % 8], claim, *run[k % 8 + 1 :])
                    k //= 8
            out.append((r["doc_id"], leaf, trees[name][-1][0], top[-1][0], H(*beside), claim, claim == top[-1][0]))
    return out


def test_op12(spark, plain):
    got = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()]
    assert sorted(got) == sorted(proofs(plain)) and {r[6] for r in got} == {True, False}


def leaves(docs):
    leaf = merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    return docs.select("doc_id", merkle.tree_name(F.col("lang")).alias("tree"), leaf.alias("leaf"), leaf.alias("claim"))


def test_merkle_edge_cases(spark, tmp_path):
    rows = [(i if i % 7 else None, "s", f"l{i % 13}" if i % 13 else None, i, None if i % 5 == 0 else "" if i % 5 == 1 else f"Text {i // 3}") for i in range(120)]
    rows += [(5, "s", "one", 1, "x" * 3_000_000), (6, None, "", None, "Ä")] + rows[:9]  # a lone leaf, an empty name, equal rows
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema)
    docs.withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("number", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()]
    want = proofs([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    by = F.col("doc_id").asc_nulls_last(), F.col("leaf")
    small = merkle.verify(leaves(docs), *by, keep=("doc_id",), levels=1)  # leaf partitions of eight, so most nodes are fetched
    assert sorted(tuple(r)[:5] for r in small.where("doc_id is not null").collect()) == sorted(r[:5] for r in want if r[0] is not None)
    assert small.where(~F.col("verified")).count() == 0
    assert merkle.verify(leaves(docs.limit(0)), *by, keep=("doc_id",)).count() == 0


def test_merkle_many_proofs_share_what_they_fetch(spark):
    """Of some leaves only: the least union of coordinates suffices, and is what single proofs need without what others determine."""
    assert merkle.missing([0, 1, 2], 9) == [(0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (1, 1)]
    assert merkle.missing(range(8), 9) == [(1, 1)] and merkle.missing([8], 9) == [(1, 0)] and merkle.missing([0], 1) == []
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    whole = merkle.Manifest.of(docs, F.col("doc_id"), interior=True, levels=2)
    zero = whole.leaves.select("tree", F.lit(0).alias("level"), "number", "size", F.col("leaf").alias("digest"))
    every = merkle.Manifest(whole.leaves, whole.nodes.where("level > 0").unionByName(zero), 2)
    some = every.prove(every.leaves.where("number % 50 = 7 OR number = 699"), with_path=True).collect()
    root = levels_over([sha(str(i).encode()) for i in range(700)])[-1][0]
    assert len(some) == 15
    for r in some:
        path = [(p["before"], p["after"]) for p in r["path"]]
        assert r["folded_root"] == root == r["subroot"] == merkle.fold(sha(str(r["number"]).encode()), path)
        assert merkle.fold(sha(b"other"), path) != root


# --- suffix-array dedup ---


def suffixes(docs: list[tuple], window: int) -> list[tuple]:
    seen = Counter(t[i : i + window] for _, t in docs for i in range(len(t) - window + 1))
    out = []
    for doc, t in docs:
        depth = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                depth[i] += 1
                depth[i + window] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def suffix_rows(docs, **options) -> list[tuple]:
    return [tuple(r) for r in suffix.remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()]


@pytest.mark.parametrize("options", [{"window": 200}, {"window": 33, "block_bytes": 4000, "bucket_suffixes": 200}])
def test_op13(spark, plain, options):
    want = suffixes([(r["doc_id"], (r["text"] or "").encode()) for r in plain], options["window"])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(suffix_rows(docs, **options)) == sorted(want) and sum(r[2] for r in want)
    if options["window"] == 200:
        assert sorted(map(tuple, QUERIES["op13_suffix_dedup"](spark, SF).collect())) == sorted(want)


def test_suffix_random(spark):
    """Few letters, so that grams tie and classes hold many different pieces."""
    rnd = random.Random(3)
    stock = ["".join(rnd.choice("ab") for _ in range(rnd.randint(10, 60))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice([*stock, "ä", "é" * 20, "a" * 40]) for _ in range(rnd.randint(0, 8)))) for i in range(150)]
    want = suffixes([(i, t.encode()) for i, t in rows], 24)
    for size in (1 << 20, 60):
        got = suffix_rows(spark.createDataFrame(rows, DOCS).repartition(5), window=24, block_bytes=500, bucket_suffixes=size)
        assert sorted(got) == sorted(want)


def test_suffix_edge_cases(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(3_000_000))
    once = "".join(rnd.choice("klmnop") for _ in range(500))
    rows = [(1, None), (2, ""), (3, long), (None, long[1_000_000:1_000_300]), (4, once), (5, "z" * 201), (6, "q" * 200), (7, once[:199]), (8, long[:250] + "!"), (8, long[:250] + "!")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS block", "2 AS bytes", "3 AS token")
    key = lambda r: tuple(map(str, r))
    want = suffixes([(i, (t or "").encode()) for i, t in rows], 200)
    assert sorted(suffix_rows(docs), key=key) == sorted(want, key=key)
    assert {r[0]: r[2] for r in want} == {1: 0, 2: 0, 3: 550, None: 300, 4: 0, 5: 201, 6: 0, 7: 0, 8: 251}
    assert suffix_rows(docs.limit(0)) == []


def test_equal_suffixes_are_spread_and_compared_across_boundaries():
    """A string sampled as several splitters: its suffixes go to several buckets, whose edges meet again."""
    import pyarrow as pa

    text = bytes(range(65, 91)) * 2
    token, rows = 77, []
    for k in range(40):
        piece = bytes([k]) + text[:20] + bytes([k, k])
        rows.append({"block": k, "at": 100 * k, "token": token, "back": 2, "n": 8, "alone": True, "bytes": piece})
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("at", pa.int32()), ("token", pa.int64()), ("back", pa.int32()), ("n", pa.int32()), ("alone", pa.bool_()), ("bytes", pa.binary())]))
    hot = (token, 1, text[:16])
    dealt = pa.Table.from_batches(suffix._dealt(iter([batch]), [(token, 0, b"B"), hot, hot, hot, (token, 2, b"A")], 16))
    spread = {r["bucket"] for r in dealt.to_pylist() if r["back"] - r["n"] < 1 <= r["back"] and r["bucket"] in (1, 2, 3, 4)}
    assert spread == {1, 2, 3, 4}
    marks, edges = {}, []
    for bucket in sorted(set(dealt.column("bucket").to_pylist())):
        found = suffix._bucket(dealt.filter(pa.compute.equal(dealt.column("bucket"), bucket)), 16, 50)
        for r in found.to_pylist():
            if r["token"] is None:
                marks.setdefault(r["block"], set()).update(np.frombuffer(r["marks"], np.int32).tolist())
            else:
                edges.append((r["token"], r["d"], r["bytes"], r["block"], r["at"]))
    equal = Counter(e[:3] for e in set(edges))
    for e in set(edges):
        if equal[e[:3]] > 1:
            marks.setdefault(e[3], set()).add(e[4])
    every = Counter(r["bytes"][j : j + 16] for r in rows for j in range(8))
    want = {r["block"]: {r["at"] + j for j in range(8) if every[r["bytes"][j : j + 16]] > 1} for r in rows}
    assert marks == {k: v for k, v in want.items() if v}
