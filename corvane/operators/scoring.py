"""Scoring: phrase scans, batching, and pluggable model calls."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from corvane.functions import phrases as P, responses, text as X
from corvane.operators import calling, packing, store
from corvane.operators.calling import NO_QUESTIONS, NOT_CONFIGURED, Ledger, Scorer, with_retry
from corvane.session import bounded
from corvane.sources.schemas import BATCH_WORDS, DIMENSIONS, LOGGED_CHARS, SCORES

RUBRICS: dict[str, str] = {
    "evasiveness": "Judge how directly management answers analysts' questions: 1 to 3 direct, 4 to 6 partly indirect, 7 to 9 mostly deflecting, 10 no answer at all.",
    "sentiment_shift": "Judge how far the tone turns negative between prepared remarks and questions: 1 to 3 steady, 4 to 6 noticeable, 7 to 9 strong, 10 a full reversal.",
    "complexity_spike": "Judge how much denser the language gets around difficult topics: 1 to 3 plain, 4 to 6 heavier, 7 to 9 obscure, 10 unintelligible.",
    "overpromising": "Judge how far claims outrun the evidence given: 1 to 3 supported, 4 to 6 hopeful, 7 to 9 inflated, 10 unsupported throughout.",
    "forward_guidance_vagueness": "Judge how vague the outlook is: 1 to 3 figures and dates, 4 to 6 ranges, 7 to 9 generalities, 10 none.",
}
CONTRACT = 'Answer with JSON only: {{"{key}": <integer 1 to 10>, "supporting_quotes": [<up to three verbatim quotes>]}}'


def system_prompt(dimension: str) -> str:
    return f"{RUBRICS[dimension]}\n{CONTRACT.format(key=f'{dimension}_score')}"


def phrase_counts(chunks: DataFrame, phrases: Sequence[str] = X.DODGE_PHRASES, text_col: str = "chunk_text") -> DataFrame:
    """``pos, phrase, hits`` over all chunks, most frequent first, ties by the phrases' order.

    Each text is scanned once for all phrases; what it counts is summed before it
    is shuffled, so a phrase is a row for each task at most.
    """
    bounded(chunks.sparkSession)
    found = chunks.select(F.explode(P.counts(F.col(text_col), phrases)).alias("f")).groupBy("f.pos").agg(F.sum("f.n").alias("hits"))
    summed = found.agg(F.map_from_entries(F.collect_list(F.struct("pos", "hits"))).alias("hits"))  # as many as there are phrases
    listed = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(p).alias("phrase"), F.coalesce(F.col("hits")[i + 1], F.lit(0)).cast("long").alias("hits")) for i, p in enumerate(phrases)])
    return summed.select(F.explode(listed).alias("f")).select("f.*").orderBy(F.desc("hits"), "pos")


def phrase_hits(chunks: DataFrame, phrases: Sequence[str] = X.DODGE_PHRASES, text_col: str = "chunk_text") -> DataFrame:
    """The columns of ``chunks`` but its text, with ``pos, phrase, hit_no, context`` of each hit, found in one scan of each text.

    A task holds a bounded batch of texts and a few megabytes of hits at a time.
    """
    bounded(chunks.sparkSession)
    rest = [c for c in chunks.columns if c != text_col]
    read = chunks.select(*rest, text_col)
    found = read.mapInArrow(P.contexts(phrases), StructType([*read.schema.fields[:-1], *StructType.fromDDL(P.HIT).fields]))
    return found.select(*rest, "pos", F.element_at(F.array(*map(F.lit, phrases)), F.col("pos")).alias("phrase"), "hit_no", "context")


def keyword_result(transcripts: DataFrame, phrases: Sequence[str] = X.DODGE_PHRASES, chunks_col: str = "chunks") -> DataFrame:
    """Add ``total_count`` and ``frequency`` (array of phrase and n, most frequent first) of the question part."""
    bounded(transcripts.sparkSession)
    joined = F.array_join(X.qa_chunks(F.col(chunks_col)), "\u0000")
    found = F.array_sort(F.transform(P.counts(joined, phrases), lambda c: F.struct((-c["n"]).alias("less"), c["pos"].alias("pos"))))
    listed = F.array(*map(F.lit, phrases))
    counted = transcripts.withColumn("_found", found)
    frequency = F.transform("_found", lambda f: F.struct(F.element_at(listed, f["pos"]).alias("phrase"), (-f["less"]).alias("n")))
    total = F.aggregate("_found", F.lit(0), lambda a, f: a - f["less"])
    return counted.withColumns({"frequency": frequency, "total_count": total}).drop("_found")


def top_phrases(chunks: DataFrame, phrases: Sequence[str] = X.DODGE_PHRASES, text_col: str = "chunk_text", *, n: int = 10) -> DataFrame:
    """The ``n`` most frequent phrases that occur at all, of :func:`phrase_counts`."""
    return phrase_counts(chunks, phrases, text_col).where("hits > 0").orderBy(F.desc("hits"), "pos").limit(n)


def first_excerpts(hits: DataFrame, keys: Sequence[str], *, n: int = 5) -> DataFrame:
    """The first ``n`` rows of :func:`phrase_hits` for each of ``keys``, by chunk, phrase and place: what a report quotes."""
    places = [c for c in ("chunk_index", "pos", "hit_no") if c in hits.columns]
    first = Window.partitionBy(*keys).orderBy(*places)
    return hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def requests(assembled: DataFrame, dimensions: Sequence[str] = DIMENSIONS, target: int = BATCH_WORDS) -> DataFrame:
    """``transcript_id, dimension, batch_no, prompt``: a row for each model call.

    Evasiveness sees the question part only; a transcript without one makes no
    call for it, which is a row without a prompt.
    """
    each = assembled.select("transcript_id", "chunks", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    asked = (F.col("dimension") != "evasiveness") | (X.qa_start(F.col("chunks")) >= 0)
    own = F.when(F.col("dimension") == "evasiveness", X.qa_chunks(F.col("chunks"))).otherwise(F.col("chunks"))
    batches = each.withColumn("asked", asked).select("transcript_id", "dimension", "asked", F.posexplode(X.batches(own, target)).alias("batch_no", "batch"))
    text = X.prompt(F.lit("Score the following call."), F.col("batch"))
    return batches.select("transcript_id", "dimension", "batch_no", F.when(F.col("asked"), text).alias("prompt"))


def question_rows(chunks: DataFrame) -> DataFrame:
    """The rows of each transcript's question part: its first chunk with an opener, and what follows."""
    opener = F.col("chunk_text").rlike(f"(?idU){X.QA_OPENER}")
    first = chunks.where(opener).groupBy("transcript_id").agg(F.min("chunk_index").alias("_first"))
    return chunks.join(first, "transcript_id").where(F.col("chunk_index") >= F.col("_first")).drop("_first")


def requests_by_rows(chunks: DataFrame, dimensions: Sequence[str] = DIMENSIONS, target: int = BATCH_WORDS) -> DataFrame:
    """As :func:`requests`, from rows ``transcript_id, chunk_index, chunk_text``: a transcript of any length, whose chunks never meet in one row."""
    chunks = chunks.select("transcript_id", "chunk_index", "chunk_text")
    others = F.array(*[F.lit(d) for d in dimensions if d != "evasiveness"]).cast("array<string>")
    text = X.prompt(F.lit("Score the following call."), F.col("batch"))
    found = packing.batches(chunks, target=target).select("transcript_id", F.explode(others).alias("dimension"), "batch_no", text.alias("prompt"))
    if "evasiveness" not in dimensions:
        return found
    asked = question_rows(chunks)
    own = packing.batches(asked, target=target).select("transcript_id", F.lit("evasiveness").alias("dimension"), "batch_no", text.alias("prompt"))
    without = chunks.select("transcript_id").distinct().join(asked.select("transcript_id").distinct(), "transcript_id", "left_anti")
    none = without.select("transcript_id", F.lit("evasiveness").alias("dimension"), F.lit(0).alias("batch_no"), F.lit(None).cast("string").alias("prompt"))
    return found.unionByName(own).unionByName(none)


def call_with_retry(scorer: Scorer, system: str, user: str, model: str, *, sleep: Callable[[float], None] = time.sleep):
    return with_retry(lambda: scorer(system, user, model), sleep=sleep)


def call_model(calls: DataFrame, scorers: Mapping[str, Scorer] | Scorer | None, model: str = "offline", **options) -> DataFrame:
    """The responses to ``calls``, a row for each; ``options`` are those of :func:`corvane.operators.calling.call_model`."""
    return calling.call_model(calls, scorers, system_prompt, model, **options)


def score(
    assembled: DataFrame, scorers: Mapping[str, Scorer] | Scorer | None, *, model: str = "offline",
    dimensions: Sequence[str] = DIMENSIONS, phrases: Sequence[str] = X.DODGE_PHRASES, **options,
) -> DataFrame:
    """A row for every transcript and dimension; a failed call leaves its dimension without a score.

    Every request is sent once.  ``model`` and ``options`` (temperature, token
    limit, rate limits, ledger) reach the calls.  ``total_count`` is the question
    part's phrase count beside evasiveness: 0 without such a part.
    """
    called = call_model(requests(assembled, dimensions), scorers, model, **options)
    return _scored(called, keyword_result(assembled, phrases).select("transcript_id", "total_count"), model)


def score_rows(
    chunks: DataFrame, scorers: Mapping[str, Scorer] | Scorer | None, *, model: str = "offline",
    dimensions: Sequence[str] = DIMENSIONS, phrases: Sequence[str] = X.DODGE_PHRASES, **options,
) -> DataFrame:
    """As :func:`score`, from rows ``transcript_id, chunk_index, chunk_text``: no transcript is ever one row."""
    called = call_model(requests_by_rows(chunks, dimensions), scorers, model, **options)
    bounded(chunks.sparkSession)
    hits = question_rows(chunks).select("transcript_id", F.explode(P.counts(F.col("chunk_text"), phrases)).alias("f"))
    summed = hits.groupBy("transcript_id").agg(F.sum("f.n").cast("int").alias("total_count"))
    return _scored(called, summed, model)


def _scored(called: DataFrame, counts: DataFrame, model: str) -> DataFrame:
    parsed = called.withColumn("p", responses.parse(F.col("raw"), F.concat("dimension", F.lit("_score")))).select("*", "p.score", "p.quotes").drop("p")
    done = responses.combine(parsed, ["transcript_id", "dimension"])
    done = done.join(counts, "transcript_id", "left").withColumn("total_count", F.when(F.col("dimension") == "evasiveness", F.coalesce("total_count", F.lit(0))))
    return done.withColumns({"model_name": F.lit(model), "prompt_version": F.concat("dimension", F.lit("-v1"))})


def unparsed(results: DataFrame) -> DataFrame:
    """``transcript_id, dimension, raw_start``: responses that gave no score, their first characters, for a log."""
    bad = results.where(F.col("score").isNull() & (F.coalesce("raw_response", F.lit("")) != ""))
    return bad.select("transcript_id", "dimension", F.substring("raw_response", 1, LOGGED_CHARS).alias("raw_start"))


def _run(spark: SparkSession, paths: store.Paths, chunks: DataFrame, scorers, resume: str | None, **options) -> DataFrame:
    """Score chunk rows, and keep the results in the run's own folder; its ledger goes once they are there.

    ``resume`` names a run that died: what it had answered is not asked again.
    """
    run = resume or uuid.uuid4().hex
    calls, kept = f"{paths.calls}/{run}", f"{paths.results}/run={run}"
    results = score_rows(chunks, scorers, ledger=Ledger(calls), **options)
    results.write.mode("overwrite").parquet(kept)
    store.delete(spark, calls)
    return spark.read.schema(results.schema).parquet(kept)


def _stamped(results: DataFrame) -> DataFrame:
    return results.withColumn("scored_at", F.current_timestamp()).withColumn("raw_llm_response", F.coalesce("raw_response", F.lit("")))


def score_and_store(
    spark: SparkSession, paths: store.Paths, scorers: Mapping[str, Scorer] | Scorer | None, *, company: str | None = None,
    year: int | None = None, skip_existing: bool = False, resume: str | None = None, **options,
) -> DataFrame:
    """Score the stored transcripts and keep what comes back; returns the run's results.

    Scores that are there are upserted, and every dimension that was asked for
    leaves its raw response as an audit row.  The results are written once, into
    the run's folder of the table of results, so storing them calls no model again.
    """
    transcripts = store.restrict(store.transcripts(spark, paths.transcripts), company, None, year)
    chunks = store.with_transcript_id(transcripts)
    if skip_existing:
        done = store.fully_scored(store.table(spark, paths.scores, SCORES), transcripts)
        chunks = chunks.join(done.select(*store.KEY), list(store.KEY), "left_anti")
    results = _run(spark, paths, chunks, scorers, resume, **options)
    stamped = _stamped(results)
    store.upsert_scores(spark, paths.scores, stamped.where("score is not null"))
    store.append_runs(paths.runs, stamped.where(~F.col("error").isin(NO_QUESTIONS, NOT_CONFIGURED) | F.col("error").isNull()))
    return results


def evaluate(
    spark: SparkSession, paths: store.Paths, scorers: Mapping[str, Scorer] | Scorer | None, *, company: str | None = None,
    quarter: str | None = None, year: int | None = None, dimension: str = "evasiveness", resume: str | None = None, **options,
) -> DataFrame:
    """One dimension of the transcripts that fit, with calls, tokens and latency; a score leaves an audit row, and no score is stored.

    Returns the results with the transcripts' keys; :func:`metrics` sums them up.
    """
    chunks = store.with_transcript_id(store.restrict(store.transcripts(spark, paths.transcripts), company, quarter, year))
    results = _run(spark, paths, chunks, scorers, resume, dimensions=(dimension,), **options)
    store.append_runs(paths.runs, _stamped(results.where("score is not null")))
    return results.join(chunks.select("transcript_id", *store.KEY).distinct(), "transcript_id")


def metrics(results: DataFrame) -> DataFrame:
    """Calls attempted, tokens, calls without a score, and latency, over transcripts that have a question part; the average is null without calls."""
    asked = results.where(F.col("error").isNull() | (F.col("error") != NO_QUESTIONS))
    return asked.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.count("total_tokens").alias("token_events"),
        F.count_if(F.col("score").isNull()).alias("failures"),
        F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency_sum"),
        (F.sum("latency") / F.count("*")).alias("latency_avg"),
    )


def validate(
    spark: SparkSession, paths: store.Paths, scorers: Mapping[str, Scorer] | Scorer | None, *, model: str = "offline",
    company: str | None = None, quarter: str | None = None, year: int | None = None, **options,
) -> DataFrame:
    """All dimensions of the first transcript that fits; nothing is stored."""
    transcripts = store.transcripts(spark, paths.transcripts)
    one = store.sample_transcript(transcripts, company, quarter, year)
    assembled = store.assemble(transcripts.join(F.broadcast(one), list(store.KEY), "left_semi"))  # one row
    return score(assembled, scorers, model=model, **options).join(F.broadcast(assembled.select("transcript_id", *store.KEY)), "transcript_id")


def dry_run(assembled: DataFrame, n_dimensions: int = len(DIMENSIONS)) -> DataFrame:
    """What a run would do: each transcript's id, chunks and calls (one for each dimension)."""
    return assembled.select("company", "quarter", "year", "transcript_id", F.size("chunks").alias("n_chunks"), F.lit(n_dimensions).alias("n_calls"))


def run_metrics(called: DataFrame) -> DataFrame:
    """Calls, tokens, failures and latency of a run; the average is null without calls."""
    return called.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.count("error").alias("failures"),
        F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency_sum"),
        F.avg("latency").alias("latency_avg"),
    )


def tally(scores: DataFrame, n: int = len(DIMENSIONS)) -> DataFrame:
    """How many transcripts got all dimensions, and how many did not."""
    per = scores.groupBy("transcript_id").agg(F.count("score").alias("ok"))
    return per.agg(F.count_if(F.col("ok") >= n).alias("succeeded"), F.count_if(F.col("ok") < n).alias("failed"))
