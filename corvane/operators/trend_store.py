"""Trends as a stored table, brought up to date for the companies whose scores changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corvane.operators import store, trends
from corvane.sources.schemas import DIMENSIONS, SCORES

#: Company, period, scores, and each dimension's delta, moving average and trend.
TRENDS = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("quarter", T.StringType()),
        *[T.StructField(d, T.IntegerType()) for d in DIMENSIONS],
        *[T.StructField(f"{d}_{end}", kind) for end, kind in (("delta", T.DoubleType()), ("ma3", T.DoubleType()), ("trend", T.StringType())) for d in DIMENSIONS],
    ]
)
#: So many companies are named to the scans one by one; more are joined.
LISTED = 1000


def bucket_of(company: Column) -> Column:
    return F.pmod(F.xxhash64(company), F.lit(store.BUCKETS)).cast("int")


def trend_rows(scores: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The table's rows, from all of ``scores`` and ``transcripts``."""
    wide = trends.pivot_scores(store.with_scores(scores, transcripts.where("chunk_index = 0")))
    return trends.moving_average(trends.trend_labels(wide)).select(TRENDS.fieldNames())


def _of(frame: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of ``companies``: a list of names that reaches the folders, or a join if they are very many."""
    few = [r[0] for r in companies.limit(LISTED + 1).collect()]
    return frame.where(F.col("company").isin(few)) if len(few) <= LISTED else frame.join(companies, "company", "left_semi")


def refresh(spark: SparkSession, paths: store.Paths, companies: DataFrame) -> None:
    """Compute the trends of ``companies`` (a column of names) again, after their scores or transcripts changed.

    Only their transcripts, the score folders of these, and the trend folders
    that hold these companies are read; of the latter the other companies' rows
    are copied.  A company has a row for each quarter, so its trends are a small whole.
    """
    companies = store.stage(companies.select("company").distinct(), paths.trends)
    transcripts = _of(store.transcripts(spark, paths.transcripts), companies)
    scores = store.table(spark, paths.scores, SCORES)
    if "bucket" in scores.columns:
        folders = transcripts.where("chunk_index = 0").select(store.bucket_of(F.col("id"))).distinct().collect()
        scores = scores.where(F.col("bucket").isin([r[0] for r in folders]))
    fresh = trend_rows(scores.select(SCORES.fieldNames()), transcripts).withColumn("bucket", bucket_of(F.col("company")))

    def renew(old: DataFrame) -> DataFrame:
        return old.join(companies, "company", "left_anti").unionByName(fresh)

    store.rewrite(spark, paths.trends, TRENDS, companies.select(bucket_of(F.col("company")).alias("bucket")), renew)
    store.unstage(companies)


def stored(spark: SparkSession, paths: store.Paths) -> DataFrame:
    return store.table(spark, paths.trends, TRENDS).select(TRENDS.fieldNames())
