"""Packing across rows, against the fold over arrays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import packing, scoring
from corvane.plans import catalog, relations as rel

SF = "/root/testdata/sf0.001"


def plain(words: list[int], target: int) -> list[int]:
    out, held, number = [], 0, -1
    for w in words:
        if number < 0 or held + w > target:
            number, held = number + 1, 0
        held += w
        out.append(number)
    return out


def test_random_words(spark):
    rnd, rows, want = random.Random(6), [], {}
    for k in range(60):
        words = [rnd.choice([0, 0, 1, 2, 5, 9, 10, 11, 40]) for _ in range(rnd.choice([1, 2, 7, 8, 9, 50, 130]))]
        want |= {(k, i): n for i, n in enumerate(plain(words, 10))}
        rows += [(k, i, w) for i, w in enumerate(words)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "transcript_id long, chunk_index int, words int")
    for block in (1, 8, 256):
        assert {(r[0], r[1]): r[2] for r in packing.numbered(frame, target=10, block=block).collect()} == want
    assert packing.numbered(frame.limit(0)).count() == 0


def test_requests_by_rows_are_the_requests(spark):
    calls = rel.calls(spark, SF)
    rows = calls.select("transcript_id", F.posexplode("chunks").alias("chunk_index", "chunk_text"))
    key = lambda frame: sorted(map(str, frame.collect()))
    want = scoring.requests(calls, target=60)
    assert key(scoring.requests_by_rows(rows, target=60)) == key(want) and want.where("batch_no > 0").count() and want.where("prompt is null").count()
    some = ("evasiveness",)
    assert key(scoring.requests_by_rows(rows, some, 60)) == key(scoring.requests(calls, some, 60))
    lists = calls.select("transcript_id", F.posexplode(X.batches(F.col("chunks"), 60)).alias("batch_no", "batch"))
    assert key(packing.batches(rows, target=60).select("transcript_id", "batch_no", "batch")) == key(lists)


def test_scores_by_rows_are_the_scores(spark):
    calls = rel.calls(spark, SF).limit(40)
    rows = calls.select("transcript_id", F.posexplode("chunks").alias("chunk_index", "chunk_text"))
    columns = ("transcript_id", "dimension", "score", "supporting_quotes", "raw_response", "error", "total_count", "calls", "total_tokens")
    key = lambda frame: sorted(map(str, frame.select(*columns).collect()))
    phrases = catalog.PHRASES
    assert key(scoring.score_rows(rows, catalog.offline_scorer, phrases=phrases)) == key(scoring.score(calls, catalog.offline_scorer, phrases=phrases))


def test_a_transcript_of_a_million_chunks(spark):
    frame = spark.range(1_000_000).select(F.lit(1).alias("transcript_id"), F.col("id").alias("chunk_index"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.hash("id") % 5 + 5).cast("int"))).alias("chunk_text"))
    found = packing.batches(frame).select("batch_no", F.size("batch").alias("n"), F.aggregate("batch", F.lit(0), lambda a, t: a + X.word_count(t)).alias("words"))
    one = found.agg(F.count("*"), F.sum("n"), F.max("words"), F.max("batch_no")).first()
    assert one[1] == 1_000_000 and one[2] <= 2000 and one[3] == one[0] - 1
