"""One scan for all phrases."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions import phrases as P
from corvane.functions.text import DODGE_PHRASES
from corvane.operators import scoring


def starts(text, *phrases):
    return sorted((pos, start) for pos, start, _ in P.scan(text, phrases))


def test_hits():
    assert starts("aaaaa", "aa") == [(1, 0), (1, 2)]  # of one phrase hits do not overlap
    assert starts("we remain committed to it", "we remain committed", "remain committed to") == [(1, 0), (2, 3)]  # of two they may
    assert starts("the other", "the", "he", "the", "") == [(1, 0), (1, 5), (2, 1), (2, 6), (3, 0), (3, 5)]
    assert starts("", "a") == starts("abc", "") == []
    assert starts("Kelvin ſo TIME WILL TELL İt", "kelvin", "so", "time will tell", "it") == [(1, 0), (2, 7), (3, 10), (4, 25)]
    assert starts("straße ﬁx", "e ﬁx") == [(1, 5)]  # characters whose upper case is two stay as long as they are


def test_against_one_search_for_each_phrase():
    rnd, phrases = random.Random(1), ("ab", "b", "aba", "bb a", "A B")
    for _ in range(500):
        text = "".join(rnd.choice("abAB .") for _ in range(rnd.randint(0, 60)))
        assert starts(text, *phrases) == [(k, m.start()) for k, p in enumerate(phrases, 1) for m in re.finditer(re.escape(p), text, re.I)]


def test_columns(spark):
    frame = spark.createDataFrame([(1, "x\nGoing  forward, going forward\n" + "y" * 50), (2, None), (3, "")], "chunk_index int, chunk_text string")
    rows = scoring.phrase_hits(frame).collect()
    assert [(r["chunk_index"], r["pos"], r["phrase"], r["hit_no"], r["context"]) for r in rows] == [(1, 1, "going forward", 0, "x Going  forward, going forward " + "y" * 39)]
    found = scoring.phrase_counts(frame).collect()
    assert len(found) == len(DODGE_PHRASES) and (found[0]["phrase"], found[0]["hits"], found[1]["hits"]) == ("going forward", 1, 0)
    assert {r["hits"] for r in scoring.phrase_counts(frame.limit(0)).collect()} == {0}


def test_time_grows_with_the_hits(spark):
    """Four times the hits in one text take at most five times as long, with all phrases and by way of Spark."""

    def seconds(n: int) -> float:
        frame = spark.range(1).select(F.lit(1).alias("chunk_index"), F.repeat(F.lit("the quick going forward "), n).alias("chunk_text"))
        began = time.perf_counter()
        hits = scoring.phrase_hits(frame, ("the", *DODGE_PHRASES))
        assert hits.agg(F.count("*"), F.max(F.length("context"))).first()[0] == 2 * n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(160_000) for _ in range(2)) <= 5 * min(seconds(40_000) for _ in range(3))


def test_memory_follows_neither_rows_nor_hits(spark):
    """Texts reach Python a few hundred at a time, and their hits leave it a few megabytes at a time, also within one text."""
    texts = ["the quick the end " * 20_000, None, "", "no hit", "the\nsame", "in the of the"]
    read = pa.RecordBatch.from_pydict({"id": pa.array(range(6)), "tag": pa.array(list("abcdef")), "text": texts})
    parts = list(P.contexts(("the", "of the"))(iter([read])))
    assert len(parts) > 1 and max(p.nbytes for p in parts) < 3 * P.OUT_BYTES
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [r["hit_no"] for r in rows if r["tag"] == "a"] == list(range(40_000))
    assert sorted(tuple(r.values()) for r in rows if r["id"] > 0) == [(4, "e", 1, 0, "the same"), (5, "f", 1, 0, "in the of the"), (5, "f", 1, 1, "in the of the"), (5, "f", 2, 0, "in the of the")]

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = scoring.phrase_hits(spark.range(3000, numPartitions=1).select("id", F.lit("the").alias("chunk_text")), ("the",))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert found.agg(F.count("*"), F.countDistinct("id")).first() == (3000, 3000)
    only_text = scoring.phrase_hits(spark.createDataFrame([("in the",), (None,)], "chunk_text string"), ("the",))
    assert only_text.columns == ["pos", "phrase", "hit_no", "context"] and [tuple(r) for r in only_text.collect()] == [(1, "the", 0, "in the")]
