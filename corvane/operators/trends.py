"""Trend analytics over scores: one window per company, built once and shared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.sources.schemas import DETERIORATING_AT, DIMENSIONS, IMPROVING_AT


def period_key() -> Column:
    """Orders quarters in time: ``year * 10 + quarter``."""
    return F.col("year") * 10 + F.substring("quarter", 2, 1).cast("int")


def period() -> Column:
    return F.concat_ws(" ", F.col("year").cast("string"), F.col("quarter"))


def chronological(frame: DataFrame) -> DataFrame:
    """Sorted by period across companies, as the reports list it."""
    return frame.orderBy(period_key(), "company")


def pivot_scores(scores: DataFrame, order: str = "transcript_id", dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Long scores to one row for each company, year and quarter; a dimension never scored is a null column."""
    return scores.groupBy("company", "year", "quarter").pivot("dimension", list(dimensions)).agg(F.min_by("score", order))


def _by_company() -> Window:
    return Window.partitionBy("company").orderBy(period_key())


def change(wide: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Add ``<dimension>_delta``: the score less the company's row before; null without either."""
    w = _by_company()
    return wide.withColumns({f"{d}_delta": (F.col(d) - F.lag(d).over(w)).cast("double") for d in dimensions if d in wide.columns})


def moving_average(wide: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Add ``<dimension>_ma3``: the mean of three rows, null unless all three have a score."""
    w = _by_company().rowsBetween(-2, 0)
    return wide.withColumns({f"{d}_ma3": F.when(F.count(d).over(w) == 3, F.avg(d).over(w)) for d in dimensions if d in wide.columns})


def label(delta: Column) -> Column:
    return F.when(delta <= IMPROVING_AT, "IMPROVING").when(delta >= DETERIORATING_AT, "DETERIORATING").otherwise("STABLE")


def trend_labels(wide: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Add deltas and ``<dimension>_trend``."""
    moved = change(wide, dimensions)
    return moved.withColumns({f"{d}_trend": label(F.col(f"{d}_delta")) for d in dimensions if d in wide.columns})


def biggest_worsening(wide: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """For each company and dimension the greatest rise of the score, the earliest of equals, with the row before; worst first."""
    stacked = wide.select("company", "year", "quarter", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dimensions if d in wide.columns])).alias("s")).select("company", "year", "quarter", "s.*")
    w = Window.partitionBy("company", "dimension").orderBy(period_key())
    moved = stacked.withColumns({"prev_quarter": F.lag("quarter").over(w), "prev_year": F.lag("year").over(w), "prev_score": F.lag("score").over(w)})
    moved = moved.withColumn("delta", (F.col("score") - F.col("prev_score")).cast("double")).where("delta > 0")
    first = Window.partitionBy("company", "dimension").orderBy(F.desc("delta"), period_key())
    top = moved.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").orderBy(F.desc("delta"), "company", "dimension")
    return top.select("company", "year", "quarter", "score", "delta", "dimension", "prev_quarter", "prev_year", "prev_score")


biggest_single_quarter_drop = biggest_worsening  #: the same under its customary name: a "drop" is a worse score


def latest(labelled: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Each company's last row: its period and trends."""
    last = F.max_by(F.struct("year", "quarter", *[f"{d}_trend" for d in dimensions]), period_key())
    return labelled.groupBy("company").agg(last.alias("l")).select("company", "l.*")


def of_company(frame: DataFrame, company: str | None) -> DataFrame:
    """Case-insensitive; no company means all.  Reaches the scan, as every window is partitioned by company."""
    return frame.where(F.upper("company") == company.upper()) if company else frame
