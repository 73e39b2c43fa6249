"""Frames behind reports and dashboard tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.operators import trends
from corvane.sources.schemas import DIMENSIONS


def dimension_averages(wide: DataFrame) -> DataFrame:
    """``dimension, average, n``: over transcripts that have it, 0 if none has."""
    per = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in DIMENSIONS])
    return wide.select(F.explode(per).alias("s")).groupBy("s.dimension").agg(F.coalesce(F.avg("s.score"), F.lit(0.0)).alias("average"), F.count("s.score").alias("n"))


def totals(wide: DataFrame) -> DataFrame:
    n = sum((F.when(F.col(d).isNotNull(), 1).otherwise(0) for d in DIMENSIONS), F.lit(0))
    return wide.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_scores"), F.count("*").alias("n_transcripts"))


def scores_tab(wide: DataFrame, company: str | None = None) -> DataFrame:
    return trends.of_company(wide, company).select("company", trends.period().alias("period"), *DIMENSIONS)


def alerts(wide: DataFrame, company: str | None = None) -> DataFrame:
    """The worst rises as ``before -> after (+delta)``."""
    worst = trends.of_company(trends.biggest_worsening(wide), company)
    note = F.format_string("%d -> %d (+%.0f)", F.col("prev_score"), F.col("score"), F.col("delta"))
    return worst.select("company", "dimension", trends.period().alias("period"), note.alias("note"))


def quotes(scores: DataFrame) -> DataFrame:
    """A row for each supporting quote; scores without any fall away."""
    return scores.select("company", "year", "quarter", "dimension", "score", F.posexplode(F.coalesce("supporting_quotes", F.array().cast("array<string>"))).alias("quote_no", "quote"))


def json_records(frame: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls kept; the whole report is a folder of JSON lines, never one string on the driver."""
    return frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("record"))


def quality(scores: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``check, bad``: orphans, duplicates and scores out of range."""
    orphans = scores.join(transcripts.select(F.col("id").alias("transcript_id")), "transcript_id", "left_anti").agg(F.count("*").alias("bad")).select(F.lit("orphan scores").alias("check"), "bad")
    twice = scores.groupBy("transcript_id", "dimension").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("bad")).select(F.lit("duplicate scores").alias("check"), "bad")
    outside = scores.agg(F.count_if(~F.col("score").between(1, 10)).alias("bad")).select(F.lit("scores out of range").alias("check"), "bad")
    return orphans.unionByName(twice).unionByName(outside)
