"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source has a weight and a size (the words of its documents).  A budget of
``share`` times all sizes is dealt out by weight; no source gets more than
``max_epochs`` times its size, and what is cut off goes to the others by weight
until none is above its cap.  Sorted by cap over weight, the clamped sources
are a prefix, so one pass over the sources (a row each) finds the fixed point.

A source's target over its size is its number of epochs: every document is
taken the whole number of times, and a seeded choice of documents once more
for the fraction.  The choice is by seeded hash order up to the wanted words:
first among the heavy documents (those with at least 1/32 of their source's
words, so at most 32 of them), then the light ones fill what is missing.  The
running sums that this needs are taken in 4,096 hash buckets for each source
and over the buckets' totals, so a hot source never meets in one task.

Null or empty texts have size 0 and are taken 0 times; a null source is a
source of its own; repeated rows count as documents of their own; ties in the
hash order go by id; a very long text is counted whole, and as a heavy document is
fitted in before the light ones; extra columns are kept; an empty table gives an
empty result.  With the same seed and rows,
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import BROADCAST_BYTES, WORD, fresh, materialize

HEAVY = 32
BUCKETS = 4096


def cycling_weights(sources: DataFrame, source_col: str, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last.  ``sources`` has a row for each source."""
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table of ``source_size, weight`` with a row for each source."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    ordered = Window.orderBy("_level", "_cap").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_level", "_cap").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_level", "_cap").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumns({"_cap": cap, "_level": level})
        .withColumns({"_below": F.coalesce(F.sum("_cap").over(ordered), F.lit(0.0)), "_weights": F.sum("weight").over(rest), "_budget": F.sum("source_size").over(everything) * F.lit(float(share))})
        # what each unit of weight would get if this source and all after it were unclamped
        .withColumn("_rate", F.when(F.col("_weights") > 0, (F.col("_budget") - F.col("_below")) / F.col("_weights")).otherwise(F.lit(0.0)))
        .withColumn("_clamped", F.col("_rate") >= F.col("_level"))
    )
    rate = F.max(F.when(~F.col("_clamped"), F.col("_rate"))).over(everything)  # the first that is not clamped
    return filled.withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * rate))).drop("_cap", "_level", "_below", "_weights", "_budget", "_rate", "_clamped")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _chosen(rows: DataFrame, wanted: Column) -> Column:
    """Whether a row's middle lies before ``wanted`` in its running sum ``_sum``."""
    return F.col("_sum") - F.col("size") / 2 < wanted


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` of each row."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("_key")), "mix-sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    stats = water_fill(cycling_weights(stats, "source", weights), share, max_epochs)
    stats = stats.withColumn("_epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    stats = stats.withColumns({"_whole": F.floor("_epochs"), "_rest": (F.col("_epochs") - F.floor("_epochs")) * F.col("source_size")})
    stats = materialize(stats.drop("weight", "_epochs"), "mix-sources")

    heavy = F.col("size") * HEAVY >= F.col("source_size")
    joined = sized.join(stats.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = ("_key", "doc_id", "size")
    running = (Window.unboundedPreceding, Window.currentRow)

    sums = joined.where(heavy & (F.col("size") > 0)).withColumn("_sum", F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(*running)))
    heavy_wanted = F.col("_rest") * F.col("_heavy") / F.col("source_size")
    all_heavy = F.sum("size").over(Window.partitionBy("source"))
    heavies = sums.withColumn("_heavy", all_heavy).withColumn("_more", _chosen(sums, heavy_wanted)).drop("_heavy")
    got = heavies.groupBy("source").agg(F.sum(F.when(F.col("_more"), F.col("size")).otherwise(0)).alias("_got"))
    got = got.withColumnRenamed("source", "_source")

    bucket = F.shiftrightunsigned("_key", 52).cast("int")  # hash order: the highest bits, the sign bit flipped
    light = joined.where(~heavy | (F.col("size") == 0)).withColumn("_bucket", bucket.bitwiseXOR(F.lit(BUCKETS // 2)))
    totals = light.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # the light documents' share, less or more what the heavy ones took: known for each source
    totals = totals.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_before", F.coalesce("_got", F.lit(0)).alias("_got"))
    totals = materialize(totals, "mix-buckets")
    inside = Window.partitionBy("source", "_bucket").orderBy(*order).rowsBetween(*running)
    light = light.withColumn("_inside", F.sum("size").over(inside))
    light = light.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    light = light.withColumn("_sum", F.col("_before") + F.col("_inside"))
    light = light.withColumn("_more", (F.col("size") > 0) & _chosen(light, F.col("_rest") - F.col("_got")))

    columns = ["doc_id", "source", "size", "source_size", "target", "_whole", "_more"]
    both = light.select(columns).unionByName(heavies.select(columns))
    repeats = F.when(F.col("size") > 0, F.col("_whole") + F.when(F.col("_more"), 1).otherwise(0)).otherwise(0)
    return both.withColumn("repeats", repeats.cast("int")).withColumn("taken", F.col("repeats") * F.col("size")).drop("_whole", "_more")


def sample(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The mix's rows: each document as often as it is taken, with the columns of ``docs``.

    ``mixed`` holds one row for each id; rows of ``docs`` that share an id share its repeats.
    """
    key, times, copy = fresh(docs, "_id"), fresh(docs, "_repeats"), fresh(docs, "_copy")
    repeats = mixed.where("repeats > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("repeats").alias(times))
    repeats = materialize(repeats, "repeats")
    if repeats.count() * 32 <= BROADCAST_BYTES:
        repeats = F.broadcast(repeats)
    rows = docs.join(repeats, F.col(id_col).eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
