"""Model responses: strict JSON parsing, and aggregation of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import let, strip_fence, strip_thinking
from corvane.sources.schemas import MAX_QUOTES, SCORE_MAX, SCORE_MIN

_STRICT = {"allowSingleQuotes": "false"}


def json_object(text: Column) -> Column:
    """The members of a JSON object as ``map<string, variant>``; null for anything else, trailing text included.

    Spark reads a value and ignores what follows it.  So the text is read twice, as
    the only element of an array and as the only member of an object: what
    follows the value would have to close the array in one and the object in the other.
    """
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:map<string,variant>>", _STRICT)
    return let(alone, lambda a: F.when((F.size(a) == 1) & member["v"].isNotNull(), a[0]))


def _last(members: Column, key: Column | str) -> Column:
    """An array of the value that ``key`` has, of repeated keys the last, or of nothing."""
    return F.slice(F.transform(F.filter(F.map_entries(members), lambda e: e["key"] == key), lambda e: e["value"]), -1, 1)


def _number(value: Column) -> Column:
    """A finite number, true as 1 and false as 0; null for any other type, strings of digits too."""
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.rlike("INT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(value, "$", "double"))
    return let(number, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def parse(raw: Column, key: Column) -> Column:
    """``score`` (clamped, half to even; null if invalid) and up to three ``quotes`` of a raw response.

    Thinking tags go first; a fence is taken off only if the text is no JSON as
    it is.  Quotes that are there but are no list leave no score.
    """

    def read(members: Column) -> Column:
        score = let(_last(members, key), lambda v: F.when(F.size(v) == 1, _number(v[0])))
        quotes = let(_last(members, "supporting_quotes"), lambda v: F.when(F.size(v) == 0, F.array().cast("array<variant>")).otherwise(F.try_variant_get(v[0], "$", "array<variant>")))
        both = F.struct(score.alias("s"), quotes.alias("q"))
        return let(both, lambda b: F.when(b["s"].isNotNull() & b["q"].isNotNull(), F.struct(
            F.bround(F.greatest(F.lit(float(SCORE_MIN)), F.least(F.lit(float(SCORE_MAX)), b["s"])), 0).cast("int").alias("score"),
            F.transform(F.slice(b["q"], 1, MAX_QUOTES), _text).alias("quotes"),
        )))

    cleaned = strip_thinking(F.coalesce(raw, F.lit("")))
    found = let(cleaned, lambda t: let(F.coalesce(json_object(t), json_object(strip_fence(t))), read))
    none = F.struct(F.lit(None).cast("int").alias("score"), F.lit(None).cast("array<string>").alias("quotes"))
    return F.coalesce(found, none)


def combine(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each transcript and dimension from its batches (``batch_no, raw, score, quotes`` and token counts).

    The mean of valid batch scores, half to even, clamped; null and an error
    text without one; quotes and raw texts in batch order; token sums, null if
    no batch reported any.  An ``error`` of any batch, where there is such a
    column, leaves no score; a ``latency`` is summed and counted as ``calls``.
    One aggregation, so what ``parsed`` costs, such as
    model calls, is paid once.
    """
    ordered = F.array_sort(F.collect_list(F.struct("batch_no", "raw", "quotes", "score")))
    usage = ("prompt_tokens", "completion_tokens", "total_tokens")
    reported = F.count(F.coalesce(*usage)) > 0
    failed = F.max("error") if "error" in parsed.columns else F.lit(None).cast("string")
    timed = [F.count("latency").alias("calls"), F.sum("latency").alias("latency")] if "latency" in parsed.columns else []
    rows = parsed.groupBy(*keys).agg(
        *timed,
        failed.alias("_failed"),
        F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), F.bround(F.avg("score"), 0).cast("int"))).alias("score"),
        ordered.alias("_rows"),
        *[F.when(reported, F.sum(F.coalesce(u, F.lit(0)))).cast("long").alias(u) for u in usage],
    )
    quotes = F.slice(F.flatten(F.transform(F.filter("_rows", lambda r: r["score"].isNotNull()), lambda r: F.coalesce(r["quotes"], F.array().cast("array<string>")))), 1, MAX_QUOTES)
    return rows.withColumns(
        {
            "score": F.when(F.col("_failed").isNull() & F.exists("_rows", lambda r: r["score"].isNotNull()), F.col("score")),
            "supporting_quotes": quotes,
            "raw_response": F.array_join(F.transform("_rows", lambda r: F.coalesce(r["raw"], F.lit(""))), "\n---\n"),
            "error": F.coalesce("_failed", F.when(~F.exists("_rows", lambda r: r["score"].isNotNull()), F.lit("No valid scores from any batch"))),
        }
    ).drop("_rows", "_failed")
