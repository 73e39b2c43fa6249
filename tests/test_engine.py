"""The transcript engine: literal cases, and every query against DuckDB."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import responses, text as X
from corvane.operators import reports, scoring, store, trends
from corvane.plans import catalog
from corvane.sources import files
from corvane.sources.schemas import DIMENSIONS, SCORES, SCORING_RUNS
from corvane.streaming.ingest import ingest_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(value):
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, (int, type(None))) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(name, spark, duck):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def wide(spark, rows):
    return spark.createDataFrame(rows, "company string, year int, quarter string, evasiveness int, sentiment_shift int")


def test_trends(spark):
    frame = wide(spark, [("A", 2023, "Q3", 8, 5), ("A", 2023, "Q4", 7, None), ("A", 2024, "Q1", 6, 5), ("A", 2024, "Q3", 8, 9), ("B", 2024, "Q1", 3, 3)])
    rows = {(r["company"], r["year"], r["quarter"]): r for r in trends.moving_average(trends.trend_labels(frame)).collect()}
    assert rows["A", 2023, "Q3"]["evasiveness_delta"] is None and rows["A", 2023, "Q3"]["evasiveness_trend"] == "STABLE"
    assert rows["A", 2023, "Q4"]["evasiveness_delta"] == -1 and rows["A", 2024, "Q3"]["evasiveness_trend"] == "DETERIORATING"
    assert rows["A", 2024, "Q1"]["evasiveness_ma3"] == 7 and rows["A", 2024, "Q1"]["sentiment_shift_ma3"] is None
    worst = {(r["company"], r["dimension"]): r for r in trends.biggest_worsening(frame).collect()}
    assert worst["A", "evasiveness"]["prev_quarter"] == "Q1" and ("B", "evasiveness") not in worst
    assert [(r["company"], r["dimension"]) for r in trends.biggest_worsening(frame).collect()] == [("A", "sentiment_shift"), ("A", "evasiveness")]
    assert [(r["quarter"], r["company"]) for r in trends.chronological(frame).collect()][-2:] == [("Q1", "B"), ("Q3", "A")]
    assert trends.biggest_worsening(frame.limit(0)).count() == 0


def test_text(spark):
    dirty = "Page 1 of 9 x\nConfidential\n\n Kept  line \nTata Consultancy Services Earnings Conference Call\n12:30 hrs IST (03:00 hrs US ET) | 3\n| 4\n___edited for readability\nEnd"
    assert one(spark, X.clean(F.lit(dirty))) == "Kept line\nEnd"
    assert one(spark, X.speaker_turns(F.lit("head\nJane Doe:\nhi\nthere\nBob Roe\nyes"))) == ["Jane Doe:\nhi\nthere", "Bob Roe:\nyes"]
    assert one(spark, X.speaker_turns(F.lit("no label here, at all"))) == ["no label here, at all"]
    assert one(spark, X.qa_start(F.array(F.lit("a"), F.lit("We'll take our  first question")))) == 1
    assert one(spark, X.qa_start(F.array(F.lit("a")))) == -1
    assert one(spark, X.batches(F.array().cast("array<string>"), 10)) == [[]]
    assert one(spark, X.title(F.lit("a_b"))) == "A B"
    assert len(X.DODGE_PHRASES) == 42


def test_pack(spark):
    units = lambda *texts: F.array(*map(F.lit, texts))
    assert one(spark, X.pack(units("a b", "c", "d e f", "g h i j k", "l"), 4)) == [["a b", "c"], ["d e f"], ["g h i j k"], ["l"]]
    assert one(spark, X.pack(units("", "a", ""), 1)) == [["", "a", ""]]
    assert one(spark, X.pack(F.array().cast("array<string>"), 4)) == []
    assert one(spark, X.pack(F.lit(None).cast("array<string>"), 4)) == []


def test_chunks(spark):
    """What the chunker's rules give, written out by hand."""
    ten = "one two three four five six seven eight nine ten"
    cases = {
        "": [],
        "A few words.": ["A few words."],
        # paragraphs are the units, packed up to the target
        f"{ten}\n\n{ten}\n\nlast words": [f"{ten} {ten}", "last words"],
        # a paragraph of over one and a half targets is cut into packed sentences, one of exactly that is not
        f"Head.\n\n{ten} a. {ten} b. Cut {ten} c. {ten} d.": ["Head.", f"{ten} a. {ten} b.", f"Cut {ten} c. {ten} d."],
        f"Head.\n\n{ten} {ten} {ten}": ["Head.", f"{ten} {ten} {ten}"],
        # one paragraph of over two targets falls back to speaker turns; what stands before the first label goes
        f"intro\nJane Doe:\n{ten} {ten}\nBob Roe\n{ten} {ten}": [f"Jane Doe:\n{ten} {ten}", f"Bob Roe:\n{ten} {ten}"],
        # and without a label to its sentences
        f"Start {ten}. {ten}. Next {ten}. Then {ten}.": [f"Start {ten}. {ten}.", f"Next {ten}.", f"Then {ten}."],
        # of two targets at most it stays
        f"{ten} {ten} {ten} {ten}".rsplit(" ", 10)[0]: [f"{ten} {ten} {ten}"],
    }
    frame = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in frame.select("text", X.chunks(F.col("text"), 20).alias("c")).collect():
        assert r["c"] == cases[r["text"]], r["text"]


RESPONSES = {
    '{"k": 15}': (10, []), '{"k": -3}': (1, []), '{"k": 2.5}': (2, []), '{"k": 3.5}': (4, []), '{"k": 4.5000001}': (5, []), '{"k": 1e1}': (10, []), '{"k": 123456789012345678901234567890123456789012}': (10, []),
    # a boolean passes as a number, a string of digits does not
    '{"k": true}': (1, []), '{"k": false}': (1, []), '{"k": "7"}': (None, None), '{"k": null}': (None, None), '{"k": [3]}': (None, None), '{"j": 3}': (None, None),
    # what parses but cannot be rounded, sliced or asked for a key leaves no score
    '{"k": NaN}': (None, None), '{"k": Infinity}': (None, None), '{"k": -Infinity}': (None, None), "[1]": (None, None), '[{"k": 1}]': (None, None), "3": (None, None), "null": (None, None),
    '{"k": 5, "supporting_quotes": null}': (None, None), '{"k": 5, "supporting_quotes": "q"}': (None, None),
    '{"k": 5, "supporting_quotes": ["a", "ä\\n\\u00e9", 3, true, "e"]}': (5, ["a", "ä\n\u00e9", "3"]),
    # of a repeated key the last counts
    '{"k": 2, "k": 8}': (8, []),
    # strict: nothing may follow, however it closes brackets
    '{"k": 1} tail': (None, None), '{"k": 1}] [{"k": 2}': (None, None), '{"k": 1}} {"k": 2': (None, None), '{"k": 1}, {"k": 2}': (None, None), '{"k": 1}, "w": {"k": 2}': (None, None),
    "{'k': 1}": (None, None), "{k: 1}": (None, None), '{"k": 01}': (None, None), '{"k": 1,}': (None, None), '{"k": 1} // c': (None, None), "x": (None, None), "": (None, None), None: (None, None),
    # fences and thinking
    '```json\n{"k": 4, "supporting_quotes": ["a","b","c","d"]}\n```': (4, ["a", "b", "c"]), '```\n{"k": 4}': (4, []), '<think>{"k": 1}</think>\n {"k": 6}\n': (6, []),
}


def test_responses(spark):
    frame = spark.createDataFrame(list(enumerate(RESPONSES)), "i int, raw string").withColumn("p", responses.parse(F.col("raw"), F.lit("k")))
    assert "Python" not in frame._jdf.queryExecution().toString()
    got = {r["raw"]: (r["p"]["score"], r["p"]["quotes"]) for r in frame.collect()}
    assert got == RESPONSES
    keyed = spark.createDataFrame([("a",), ("b",)], "k string").select("k", responses.parse(F.lit('{"a": 1, "b": 2}'), F.col("k"))["score"].alias("s"))
    assert {r["k"]: r["s"] for r in keyed.collect()} == {"a": 1, "b": 2}


def test_retry():
    slept, calls = [], []

    def limited(*_):
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("429 slow down")
        return "ok"

    assert scoring.call_with_retry(limited, "", "", "", sleep=slept.append) == "ok" and slept == [2, 4, 8]
    with pytest.raises(ValueError):
        scoring.call_with_retry(lambda *_: (_ for _ in ()).throw(ValueError("other")), "", "", "", sleep=slept.append)
    assert len(slept) == 3


CALLS = [(1, ["intro", "we'll take our first question", "going forward, at this point"]), (2, ["no questions"])]


def test_scoring(spark):
    frame = spark.createDataFrame(CALLS, "transcript_id long, chunks array<string>")
    found = {(r["transcript_id"], r["dimension"]): r for r in scoring.score(frame, catalog.offline_scorer).collect()}
    assert len(found) == 10
    none = found.pop((2, "evasiveness"))  # no question part: no call, no score, no phrases
    assert none["score"] is None and none["error"] == scoring.NO_QUESTIONS and none["total_count"] == 0
    assert all(1 <= r["score"] <= 10 and r["error"] is None for r in found.values())
    assert found[1, "evasiveness"]["total_count"] == 2 and found[1, "overpromising"]["total_count"] is None
    words = {r["transcript_id"]: r["total_count"] for r in scoring.keyword_result(frame).collect()}
    assert words == {1: 2, 2: 0}

    def broken(*_):
        raise RuntimeError("down")

    errors = lambda scorers: {r["error"] for r in scoring.score(frame, scorers).collect() if r["score"] is None}
    assert errors(broken) == {"down", scoring.NO_QUESTIONS}
    assert errors(None) == errors({}) == {scoring.NOT_CONFIGURED, scoring.NO_QUESTIONS}


def test_each_request_is_sent_once(spark, tmp_path):
    frame = spark.range(20).selectExpr("id as transcript_id", "array('we have our first question', 'text') as chunks")
    log = str(tmp_path / "calls")

    def counting(system, prompt, model):
        with open(log, "a") as f:
            f.write("x\n")
        return catalog.offline_scorer(system, prompt, model)

    assert scoring.score(frame, counting).where("score is not null").count() == 100
    with open(log) as f:
        assert len(f.readlines()) == scoring.requests(frame).count() == 100


def test_score_and_store(spark, tmp_path):
    at = store.Paths.under(str(tmp_path))
    rows = [("ACME", q, 2024, f"ACME_{q}_2024.pdf", ["hello", "we'll take our first question", "time will tell"] if q == "Q1" else ["hello"]) for q in ("Q1", "Q2")]
    totals = store.replace_transcripts(spark, at.transcripts, spark.createDataFrame(rows, "company string, quarter string, year int, source_file string, chunks array<string>"))
    assert totals == {"documents": 2, "chunks": 4, "words": 10}
    log = str(tmp_path / "calls")

    def counting(system, prompt, model):
        with open(log, "a") as f:
            f.write(f"{model}\n")
        return catalog.offline_scorer(system, prompt, model)

    results = scoring.score_and_store(spark, at, counting, model="m")
    assert results.count() == 10
    scores, runs = store.table(spark, at.scores, SCORES), store.table(spark, at.runs, SCORING_RUNS)
    assert scores.count() == 9 and runs.count() == 9 and {r["model_name"] for r in runs.collect()} == {"m"}
    again = scoring.score_and_store(spark, at, counting, model="m2", skip_existing=True)  # only the call without a question part
    assert again.count() == 5
    with open(log) as f:
        assert sorted(f.read().split()) == ["m"] * 9 + ["m2"] * 4
    spark.catalog.refreshByPath(at.scores)
    assert sorted(r["model_name"] for r in store.table(spark, at.scores, SCORES).collect()) == ["m"] * 5 + ["m2"] * 4
    assert store.table(spark, at.runs, SCORING_RUNS).count() == 13
    transcripts = store.transcripts(spark, at.transcripts)
    looked = store.get_scores(store.table(spark, at.scores, SCORES), transcripts, "acme", "Q1", 2024).collect()
    assert [r["dimension"] for r in looked] == sorted(DIMENSIONS)
    checked = scoring.validate(spark, at, None, company="acme")
    assert checked.count() == 5 and {r["quarter"] for r in checked.collect()} == {"Q1"}
    assert store.table(spark, at.scores, SCORES).count() == 9


def test_store(spark, tmp_path):
    path = f"{tmp_path}/transcripts"
    docs = lambda chunks: spark.createDataFrame([("A", "Q1", 2024, "A_Q1_2024.pdf", chunks)], "company string, quarter string, year int, source_file string, chunks array<string>")

    for chunks in (["a b", "c"], ["new one"], []):
        store.replace_transcripts(spark, path, docs(chunks))
        stored = store.transcripts(spark, path)
        assert [r["chunk_text"] for r in store.get_chunks(stored, "a").collect()] == chunks
    scores = f"{tmp_path}/scores"
    made = lambda n, value: spark.range(n).selectExpr("id transcript_id", "'evasiveness' dimension", f"{value} score", "array('q') supporting_quotes", "current_timestamp() scored_at", "'m' model_name", "'v' prompt_version", "'r' raw_llm_response")
    for n, value in ((300, 3), (1, 9), (0, 1)):
        store.upsert_scores(spark, scores, made(n, value))
        spark.catalog.refreshByPath(scores)
    found = {r["transcript_id"]: r["score"] for r in store.table(spark, scores, SCORES).collect()}
    assert found == {0: 9} | dict.fromkeys(range(1, 300), 3)
    assert not list((tmp_path / "scores.staged").iterdir())
    assert reports.quality(store.table(spark, scores, SCORES), spark.range(300)).where("bad > 0").count() == 0
    runs = f"{tmp_path}/runs"
    for _ in range(2):
        store.append_runs(runs, made(2, 5))
    assert store.table(spark, runs, SCORING_RUNS).count() == 4


def test_clean_text_files(spark, tmp_path):
    frame = spark.createDataFrame([("/in/A_Q1_2024.pdf", "Confidential\n first  line \n\n12\nsecond"), ("/in/B_Q1_2024.pdf", "x")], "path string, text string")
    for _ in range(2):
        files.write_clean_texts(frame, f"{tmp_path}/texts")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/texts/stem=A_Q1_2024").collect()] == ["first line", "second"]


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for q in ("Q1", "Q2"):
        (folder / f"acme_{q}_2024.pdf").write_text("We have our first question. " + "Time will tell. " * (20 if q == "Q1" else 40))
    (folder / "bad name.pdf").write_text("x " * 100)
    run = lambda command, *more: cli.main([command, "--store", f"{tmp_path}/store", *more], spark)
    assert run("ingest", str(folder), "--log", f"{tmp_path}/log.txt")["documents"] == 2
    assert "bad name" in (tmp_path / "log.txt").read_text()
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/store/rejects").collect()] == [files.NAME_FORM]
    scorer = ("--scorer", "corvane.plans.catalog:offline_scorer", "--model", "m")
    assert run("score", "--dry-run").collect()[0]["n_calls"] == 5
    assert run("score").where("score is null and error = 'LLM not configured'").count() == 10
    assert run("score", *scorer).where("score is not null").count() == 10
    assert run("score", "--dry-run", "--skip-existing").count() == 0
    assert run("evasiveness", "--company", "acme").collect()[0]["total_count"] > 0
    runs_before = spark.read.parquet(f"{tmp_path}/store/scoring_runs").count()
    scored = run("evasiveness", "--company", "acme", *scorer).collect()
    assert len(scored) == 2 and all(r["score"] is not None and r["latency"] >= 0 for r in scored)
    spark.catalog.refreshByPath(f"{tmp_path}/store/scoring_runs")
    assert spark.read.parquet(f"{tmp_path}/store/scoring_runs").count() == runs_before + 2
    assert run("validate", "--year", "2024", *scorer).count() == 5
    run("trend", "--company", "Acme", "--json", f"{tmp_path}/trends.json")
    report = json.loads((tmp_path / "trends.json").read_text())
    assert list(report) == ["qoq_deltas", "rolling_averages", "trend_labels", "biggest_drops"] and len(report["qoq_deltas"]) == 2
    assert report["qoq_deltas"][0] == {"company": "ACME", "quarter": "Q1", "year": 2024} | {f"{d}_delta": None for d in DIMENSIONS}
    assert run("check").where("bad > 0").count() == 0
    assert "Evasiveness" in capsys.readouterr().out


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "acme_Q2_2024.PDF").write_text("Page 1 of 2\n" + "Word here. " * 60)
    (folder / "bad name.pdf").write_text("x " * 100)
    (folder / "tiny_Q1_2024.pdf").write_text("too short")

    assert [r["path"].rsplit("/", 1)[1] for r in files.listing(files.scan(spark, str(folder))).collect()] == ["acme_Q2_2024.PDF", "bad name.pdf", "tiny_Q1_2024.pdf"]
    files.ingest(spark, str(folder), f"{tmp_path}/a")
    rows = store.transcripts(spark, f"{tmp_path}/a").collect()
    assert [(r["company"], r["quarter"], r["year"], r["word_count"]) for r in rows] == [("ACME", "Q2", 2024, 120)]
    ingest_stream(spark, str(folder), f"{tmp_path}/b", f"{tmp_path}/c").awaitTermination(120)
    assert store.transcripts(spark, f"{tmp_path}/b").count() == 1
    assert len(DIMENSIONS) == 5
