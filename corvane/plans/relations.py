"""Relations of the transcript domain, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import trends
from corvane.session import ship
from corvane.sources.schemas import DIMENSIONS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, year, quarter, dimension, score, transcript_id``: order counts by segment, quarter and priority."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("company"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
        F.element_at(F.array(*map(F.lit, DIMENSIONS)), F.substring("o_orderpriority", 1, 1).cast("int")).alias("dimension"),
    )
    counted = rows.groupBy("company", "year", "quarter", "dimension").agg((1 + F.count("*") % 10).cast("int").alias("score"))
    return counted.withColumn("transcript_id", (trends.period_key() * 1000 + F.ascii("company")).cast("long"))


def scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.pivot_scores(scores_long(spark, sf_dir))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, company, quarter, year`` of every transcript."""
    return scores_long(spark, sf_dir).select(F.col("transcript_id").alias("id"), "company", "quarter", "year").distinct()


def replaced_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts after some were ingested anew under another id, which leaves their scores orphaned."""
    stale = F.col("id") % 7 == 0
    return transcripts(spark, sf_dir).withColumn("id", F.when(stale, -F.col("id")).otherwise(F.col("id")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transcript_id, chunk_index, role, chunk_text``."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), "role", F.col("text").alias("chunk_text"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transcript_id, chunks``: a conversation's turns, an opener of the question part before every third's second turn."""
    turns = conversations(spark, sf_dir).where("chunk_text is not null")
    opener = (F.col("transcript_id") % 3 == 0) & (F.col("chunk_index") == 1)
    text = F.when(opener, F.concat(F.lit("We'll take our FIRST question now. "), F.col("chunk_text"))).otherwise(F.col("chunk_text"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", text.alias("t"))))
    return turns.groupBy("transcript_id").agg(F.transform(ordered, lambda c: c["t"]).alias("chunks"))


#: Forms of a response; ``@n`` is a number and ``@w`` a word of the document.
RESPONSES = (
    '{"s": @n, "supporting_quotes": ["@w", "b"]}',
    '```json\n{"s": @n.5, "supporting_quotes": ["@w"]}\n```',
    '<think>so\nso</think>\n {"s": 1@n, "supporting_quotes": ["d", "@w", "f", "g"]}',
    "no JSON at all but @w",
    '{"s": -@n, "supporting_quotes": []}',
    '{"s": "@n", "supporting_quotes": ["h"]}',
    '{"s": true}',
    '{"s": @n.5, "supporting_quotes": ["@w"]}',
    '{"s": @n} and more',
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transcript_id, dimension, batch_no, raw`` and token counts: a response for each document, in a form by its id, about its text."""
    docs = documents(spark, sf_dir)
    form = F.element_at(F.array(*map(F.lit, RESPONSES)), (F.col("doc_id") % len(RESPONSES) + 1).cast("int"))
    number = (F.coalesce(F.length("text"), F.lit(0)) % 12).cast("string")
    raw = F.replace(F.replace(form, F.lit("@n"), number), F.lit("@w"), F.coalesce(F.regexp_extract("text", "[a-z]+", 0), F.lit("")))
    return docs.select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("transcript_id"),
        F.element_at(F.array(*map(F.lit, DIMENSIONS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("dimension"),
        F.floor(F.col("doc_id") % 10 / 5).cast("int").alias("batch_no"),
        raw.alias("raw"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 100).alias("prompt_tokens"),
        F.when(F.col("doc_id") % 4 == 1, F.lit(7)).cast("long").alias("completion_tokens"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 100 + 7).alias("total_tokens"),
    )
