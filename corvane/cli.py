"""Command line: ``python -m corvane.cli COMMAND --store FOLDER``.

Each command is a thin call of the library.  What a command prints is the head
of a table, and says of how many rows; the tables themselves stay in the store.
Options that are not given come from ``--settings``, a TOML file.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane import log
from corvane.functions import text as X
from corvane.operators import reports, scoring, store, trends
from corvane.session import get_session
from corvane.settings import Settings
from corvane.sources import files
from corvane.sources.report import write_report
from corvane.sources.schemas import DIMENSIONS, REJECTS, SCORES, SCORING_RUNS

#: Rows of a printed table.
SHOWN = 200


def _named(place: str | None):
    """``module:function``, or nothing: then no scorer is configured."""
    if not place:
        return None
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def _show(title: str, frame: DataFrame) -> None:
    head = frame.limit(SHOWN + 1).collect()
    print(f"\n=== {title} ===" + (f" {SHOWN} of {frame.count()} rows" if len(head) > SHOWN else ""))
    frame.show(SHOWN, truncate=False)


def _warn(logger, frame: DataFrame, message: str, *columns: str) -> None:
    """A line for each row of the head of ``frame``, and one that says how many there are beyond."""
    head = frame.limit(SHOWN + 1).collect()
    for r in head[:SHOWN]:
        logger.warning(message, *(r[c] for c in columns))
    if len(head) > SHOWN:
        logger.warning("These were %d of %d", SHOWN, frame.count())


def _tables(spark: SparkSession, at: store.Paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    return store.transcripts(spark, at.transcripts), store.table(spark, at.scores, SCORES).select(SCORES.fieldNames()), store.table(spark, at.runs, SCORING_RUNS)


def _wide(scores: DataFrame, transcripts: DataFrame) -> DataFrame:
    return trends.pivot_scores(store.with_scores(scores, transcripts.where("chunk_index = 0")))


def ingest(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> dict[str, int]:
    """Files to the store; those that are no transcripts to its table of rejects."""
    logger, set_ = log.setup(args.log), args.set_
    rejects = f"{args.store.rstrip('/')}/rejects"
    before = store.table(spark, rejects, REJECTS).agg(F.max("rejected_at")).first()[0]
    totals = files.ingest(spark, args.folder, at.transcripts, rejects=rejects, target=set_.chunk_words, min_words=set_.min_words)
    own = store.table(spark, rejects, REJECTS).where(F.lit(True) if before is None else F.col("rejected_at") > F.lit(before))
    _warn(logger, own.orderBy("path"), "Skipped %s: %s", "path", "reason")
    logger.info("Stored %(documents)d documents, %(chunks)d chunks, %(words)d words; rejected %(rejected)d files", totals)
    return totals


def _report_run(logger, results: DataFrame) -> None:
    failed = results.where("score is null").groupBy("dimension", "error").agg(F.count("*").alias("n")).orderBy("dimension", "error")
    _warn(logger, failed, "No score on %s for %d transcripts: %s", "dimension", "n", "error")
    _warn(logger, scoring.unparsed(results).orderBy("transcript_id", "dimension"), "No score in the response on %s of transcript %d: %s", "dimension", "transcript_id", "raw_start")


def score(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> DataFrame:
    """Model scores of the stored transcripts."""
    logger, set_ = log.setup(args.log), args.set_
    transcripts, scores, _ = _tables(spark, at)
    if args.dry_run:
        wanted = store.assemble(store.restrict(transcripts, args.company, None, args.year))
        if args.skip_existing:
            wanted = wanted.join(store.fully_scored(scores, transcripts).select(*store.KEY), list(store.KEY), "left_anti")
        plan = scoring.dry_run(wanted)
        _show("DRY RUN", plan.orderBy("company", "year", "quarter"))
        return plan
    results = scoring.score_and_store(spark, at, _named(set_.scorer), company=args.company, year=args.year, skip_existing=args.skip_existing, resume=args.resume, **set_.calling)
    _report_run(logger, results)
    tally = scoring.tally(results).first()
    logger.info("%d transcripts with all dimensions, %d without", tally["succeeded"], tally["failed"])
    transcripts, scores, _ = _tables(spark, at)
    wide = trends.of_company(_wide(scores, transcripts), args.company)
    _show("SCORES SUMMARY", wide.orderBy("company", "year", "quarter"))
    _show("AVERAGE", reports.dimension_averages(wide))
    return results


def evasiveness(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> DataFrame:
    """The question part's phrases of a company's calls, with excerpts; with a scorer its scores, calls, tokens and latency."""
    logger, set_ = log.setup(args.log), args.set_
    transcripts = store.restrict(_tables(spark, at)[0], args.company, args.quarter, args.year)
    calls = scoring.keyword_result(store.assemble(transcripts).withColumn("qa_start", X.qa_start(F.col("chunks"))))
    report = calls.select(*store.KEY, "qa_start", "total_count", F.slice("frequency", 1, 10).alias("top_phrases"))
    _show("QUESTION PART", report.orderBy("company", "year", "quarter"))
    rows = calls.select(*store.KEY, F.posexplode(X.qa_chunks(F.col("chunks"))).alias("chunk_index", "chunk_text"))
    _show("EXCERPTS", scoring.first_excerpts(scoring.phrase_hits(rows), store.KEY).orderBy("company", "year", "quarter", "chunk_index", "pos", "hit_no"))
    if set_.scorer:
        results = scoring.evaluate(spark, at, _named(set_.scorer), company=args.company, quarter=args.quarter, year=args.year, resume=args.resume, **set_.calling)
        _report_run(logger, results)
        _show("EVASIVENESS", results.select(*store.KEY, "score", "supporting_quotes", "prompt_tokens", "completion_tokens", "total_tokens", "latency", "error").orderBy("company", "year", "quarter"))
        _show("TOTALS", scoring.metrics(results))
        return report.join(results.select(*store.KEY, "score", "total_tokens", "latency", "error"), list(store.KEY))
    return report


def validate(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> DataFrame:
    """All dimensions of one transcript; nothing is stored."""
    found = scoring.validate(spark, at, _named(args.set_.scorer), **args.set_.calling, company=args.company, quarter=args.quarter, year=args.year)
    _show("VALIDATION", found.select(*store.KEY, X.title(F.col("dimension")).alias("dimension"), "score", "supporting_quotes", "error"))
    return found


def trend(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> DataFrame:
    """Changes, moving averages, labels and worst rises."""
    transcripts, scores, _ = _tables(spark, at)
    wide = trends.of_company(_wide(scores, transcripts), args.company)
    moved = trends.moving_average(trends.trend_labels(wide))
    frames = {name: trends.chronological(moved).select("company", "quarter", "year", *[f"{d}_{end}" for d in DIMENSIONS]) for name, end in (("qoq_deltas", "delta"), ("rolling_averages", "ma3"), ("trend_labels", "trend"))}
    frames["biggest_drops"] = trends.biggest_worsening(wide)
    for name, frame in frames.items():
        _show(name, frame)
    if args.json:
        write_report(frames, args.json)
    return frames["biggest_drops"]


def check(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> DataFrame:
    """What the store holds, and its quality checks."""
    transcripts, scores, runs = _tables(spark, at)
    evasive = store.with_scores(scores, transcripts).where("dimension = 'evasiveness'").select(*store.KEY)
    _show("EVASIVENESS SCORES", evasive.orderBy("company", "year", "quarter"))
    _show("SCORING RUNS", store.with_scores(runs, transcripts).groupBy(*store.KEY).agg(F.count("*").alias("runs")).orderBy("company", "year", "quarter"))
    _show("TRANSCRIPTS", store.unique_transcripts(transcripts))
    found = reports.quality(scores, transcripts)
    _show("QUALITY", found)
    return found


def vacuum(spark: SparkSession, at: store.Paths, args: argparse.Namespace) -> int:
    """Delete replaced versions of transcripts; for times without readers."""
    gone = store.vacuum(spark, at.transcripts)
    log.setup(args.log).info("Deleted %d replaced transcripts", gone)
    return gone


COMMANDS = {f.__name__: f for f in (ingest, score, evasiveness, validate, trend, check, vacuum)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description="Transcripts: ingest, scores, trends.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        own = commands.add_parser(name, help=f.__doc__)
        own.add_argument("--settings", help="TOML file with settings")
        own.add_argument("--store", help="folder of the store's tables")
        own.add_argument("--log", help="file that gets every message")
        if name == "ingest":
            own.add_argument("folder")
            own.add_argument("--chunk-words", type=int)
            own.add_argument("--min-words", type=int)
        if name in ("score", "evasiveness", "validate", "trend"):
            own.add_argument("--company")
        if name in ("score", "evasiveness", "validate"):
            own.add_argument("--year", type=int)
            own.add_argument("--scorer", help="module:function that calls the model")
            own.add_argument("--model")
            own.add_argument("--temperature", type=float)
            own.add_argument("--max-tokens", type=int)
            own.add_argument("--tokens-per-minute", type=int, help="budget that all tasks share")
            own.add_argument("--parallel", type=int, help="tasks that call at once, at most")
            own.add_argument("--concurrency", type=int, help="calls at once in a task")
        if name in ("evasiveness", "validate"):
            own.add_argument("--quarter")
        if name in ("score", "evasiveness"):
            own.add_argument("--resume", help="run that died: its folder's name under scoring_calls")
        if name == "score":
            own.add_argument("--dry-run", action="store_true")
            own.add_argument("--skip-existing", action="store_true")
        if name == "trend":
            own.add_argument("--json", help="file for the frames' record lists")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None):
    """Run a command; its frame, or its totals, is returned to callers from Python."""
    args = parser().parse_args(arguments)
    args.set_ = Settings.load(args.settings).over(**vars(args))
    args.store, args.log = args.set_.store, args.set_.log
    if not args.store:
        raise SystemExit("corvane: --store, or store in the settings, is needed")
    return COMMANDS[args.command](spark or get_session(), store.Paths.under(args.store), args)


if __name__ == "__main__":
    main()
