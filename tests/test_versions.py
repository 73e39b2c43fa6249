"""Replacing transcripts: old or new whole, orphaned scores, commits, vacuum."""

from __future__ import annotations

import pytest

from corvane.operators import reports, scoring, store
from corvane.plans import catalog
from corvane.sources.schemas import SCORES

DOCS = "company string, quarter string, year int, source_file string, chunks array<string>"


def docs(spark, *rows):
    return spark.createDataFrame([("ACME", q, 2024, f"ACME_{q}_2024.pdf", chunks) for q, chunks in rows], DOCS)


def texts(spark, path):
    return sorted((r["quarter"], r["chunk_index"], r["chunk_text"]) for r in store.transcripts(spark, path).collect())


def test_replaced_text_orphans_its_scores(spark, tmp_path):
    at = store.Paths.under(str(tmp_path))
    put = lambda *rows: store.replace_transcripts(spark, at.transcripts, docs(spark, *rows))
    scores = lambda: store.table(spark, at.scores, SCORES).select(SCORES.fieldNames())
    joined = lambda: store.with_scores(scores(), store.transcripts(spark, at.transcripts)).count()
    bad = lambda: {r["check"]: r["bad"] for r in reports.quality(scores(), store.transcripts(spark, at.transcripts)).collect()}["orphan scores"]
    talk = ["hello", "we'll take our first question", "time will tell"]
    put(("Q1", talk), ("Q2", ["we have our first question"]))
    scoring.score_and_store(spark, at, catalog.offline_scorer)
    assert joined() == 10 and bad() == 0
    put(("Q1", talk))  # the same text again is the same transcript
    assert joined() == 10 and bad() == 0
    put(("Q1", [*talk[:2], "another answer"]))  # the first chunk is as it was, and yet it is another transcript
    assert joined() == 5 and bad() == 5
    again = scoring.score_and_store(spark, at, catalog.offline_scorer, skip_existing=True)
    assert again.count() == 5 and joined() == 10
    assert not (tmp_path / "scores.staged").exists() or not list((tmp_path / "scores.staged").iterdir())
    assert not list((tmp_path / "transcripts.staged").iterdir())
    assert not (tmp_path / "scoring_calls").exists() or not list((tmp_path / "scoring_calls").iterdir())


def test_a_crash_between_the_writes_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    store.replace_transcripts(spark, path, docs(spark, ("Q1", ["old", "text"]), ("Q2", ["other"])))
    before = texts(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.replace_transcripts(spark, path, docs(spark, ("Q1", ["new"]), ("Q3", ["more"])))
    assert texts(spark, path) == before
    assert store.vacuum(spark, path) == 2  # what the lost ingest wrote
    store.replace_transcripts(spark, path, docs(spark, ("Q1", ["new"])))
    assert texts(spark, path) == [("Q1", 0, "new"), ("Q2", 0, "other")]
    assert store.vacuum(spark, path) == 1
    assert texts(spark, path) == [("Q1", 0, "new"), ("Q2", 0, "other")]
    store.replace_transcripts(spark, path, docs(spark, ("Q1", [])))
    assert texts(spark, path) == [("Q2", 0, "other")]


def test_commits_at_once_get_different_numbers(spark, tmp_path):
    path = f"{tmp_path}/t"
    pointers = lambda v: spark.createDataFrame([("A", "Q1", 2024, v, 1)], "company string, quarter string, year int, version string, n_chunks int")
    assert store.commit(pointers("a"), path) == 1
    # another ingest takes the number between the look and the rename
    (tmp_path / "t/commits/commit=2").mkdir()
    assert store.commit(pointers("b"), path) == 3
    assert [r["version"] for r in store.latest_versions(spark, path).collect()] == ["b"]


def test_filters_reach_the_folders(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans are cut short
    path = f"{tmp_path}/t"
    store.replace_transcripts(spark, path, docs(spark, ("Q1", ["a"]), ("Q2", ["b"])))
    plan = store.restrict(store.transcripts(spark, path), "acme", "Q1", 2024)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/data" in line]
    assert scans and all("(company#" in s and "= ACME)" in s.partition("PartitionFilters")[2] for s in scans)


def test_a_look_up_reads_the_folders_of_its_transcripts(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    at = store.Paths.under(str(tmp_path))
    store.replace_transcripts(spark, at.transcripts, docs(spark, *[(f"Q{q}", [f"we have our first question {q}", "more"]) for q in (1, 2, 3, 4)]))
    scoring.score_and_store(spark, at, catalog.offline_scorer)
    scores, transcripts = store.table(spark, at.scores, SCORES), store.transcripts(spark, at.transcripts)
    found = store.get_scores(scores, transcripts, "acme", "Q2", 2024)
    plan = found._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/scores" in line]
    assert scans and all("bucket#" in s.partition("PartitionFilters: ")[2].partition("PushedFilters")[0] for s in scans)
    assert [r["quarter"] for r in found.collect()] == ["Q2"] * 5
    assert store.get_scores(scores, transcripts, "acme").count() == 20 and store.get_scores(scores, transcripts, "none").count() == 0
