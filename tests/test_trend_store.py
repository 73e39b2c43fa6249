"""Stored trends after upserts, against the full computation."""

from __future__ import annotations

import random

from corvane.operators import store, trend_store
from corvane.sources.schemas import DIMENSIONS, SCORES

DOCS = "company string, quarter string, year int, source_file string, chunks array<string>"
NEW = "transcript_id long, dimension string, score int"


def test_equal_to_the_full_computation(spark, tmp_path):
    at, rnd = store.Paths.under(str(tmp_path)), random.Random(2)
    keys = [(f"C{c}", f"Q{q}", y) for c in range(6) for y in (2023, 2024) for q in (1, 2, 3, 4)]
    put = lambda rows: store.replace_transcripts(spark, at.transcripts, spark.createDataFrame([(c, q, y, "f", ["text " + t]) for c, q, y, t in rows], DOCS))
    put([(*k, "one") for k in keys])

    def full():
        scores = store.table(spark, at.scores, SCORES).select(SCORES.fieldNames())
        return sorted(map(str, trend_store.trend_rows(scores, store.transcripts(spark, at.transcripts)).collect()))

    def upsert(picked):
        ids = {(r["company"], r["quarter"], r["year"]): r["id"] for r in store.transcripts(spark, at.transcripts).collect()}
        rows = spark.createDataFrame([(ids[k], d, s) for k, d, s in picked], NEW)
        extra = {"supporting_quotes": "array('q')", "scored_at": "current_timestamp()", "model_name": "'m'", "prompt_version": "'v'", "raw_llm_response": "'r'"}
        store.upsert_scores(spark, at.scores, rows.selectExpr("*", *(f"{e} AS {c}" for c, e in extra.items())))
        for path in (at.scores, at.trends):
            spark.catalog.refreshByPath(path)

    companies = lambda names: spark.createDataFrame([(n,) for n in names], "company string")
    done = 0
    while done < 100:  # a hundred random scores, some in one upsert
        n = rnd.randint(5, 30)
        picked = {(rnd.choice(keys), rnd.choice(DIMENSIONS)): rnd.randint(1, 10) for _ in range(n)}
        upsert([(k, d, s) for (k, d), s in picked.items()])
        trend_store.refresh(spark, at, companies(sorted({k[0] for k, _ in picked})))
        spark.catalog.refreshByPath(at.trends)
        assert sorted(map(str, trend_store.stored(spark, at).collect())) == full()
        done += n
    put([("C1", "Q2", 2024, "two")])  # a replaced transcript loses its scores, and the rows after it their deltas
    trend_store.refresh(spark, at, companies(["C1"]))
    spark.catalog.refreshByPath(at.trends)
    assert sorted(map(str, trend_store.stored(spark, at).collect())) == full()
    assert not list((tmp_path / "trends.staged").iterdir())


def test_reads_touched_companies_only(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans are cut short
    at, plans = store.Paths.under(str(tmp_path)), []
    rows = [(f"C{c}", "Q1", 2024, "f", [f"text {c}"]) for c in range(5)]
    store.replace_transcripts(spark, at.transcripts, spark.createDataFrame(rows, DOCS))
    real = store.rewrite

    def noting(spark_, path, schema, touched, renew):
        def renewed(old):
            plans.append(renew(old)._jdf.queryExecution().toString())
            return renew(old)

        real(spark_, path, schema, touched, renewed)

    monkeypatch.setattr(store, "rewrite", noting)
    trend_store.refresh(spark, at, spark.createDataFrame([("C3",), ("C3",)], "company string"))
    scans = [line for line in plans[0].splitlines() if "FileScan" in line and "chunk_index#" in line]
    assert scans and all("(company#" in s.partition("PartitionFilters")[2] and "= C3)" in s for s in scans)
