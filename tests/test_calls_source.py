"""The data source of calls."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.sources import calls as C, files

LOG = "CORVANE_TEST_OPENED"


def logging_pages(content: bytes) -> list[str]:
    """An extractor that notes each file it is given."""
    pages = files.plain_pages(content)
    with open(pages[0].splitlines()[0], "a") as f:
        f.write("x")
    return pages


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    for company in ("acme", "Zeta&Co", "Other"):
        for q in (1, 2):
            for year in (2023, 2024):
                (place / f"{company}_Q{q}_{year}.{'PDF' if q == 1 else 'pdf'}").write_text(f"{tmp_path}/opened\nfirst\fsecond " + "word " * 60)
    (place / "bad name.pdf").write_text("x")
    (place / "notes.txt").write_text("x")
    (place / "sub.pdf").mkdir()
    return place


def test_a_query_opens_only_the_files_it_names(spark, tmp_path, folder):
    opened = lambda: len(Path(f"{tmp_path}/opened").read_text()) if os.path.exists(f"{tmp_path}/opened") else 0
    load = lambda **keys: C.calls(spark, str(folder), extractor=f"{__name__}:logging_pages", **keys)
    assert load(company="acme").count() == 4 and opened() == 4
    rows = load(company=["Acme", "Zeta&Co"], year=2024).where(F.length("text") > 10).collect()
    assert sorted((r["company"], r["quarter"]) for r in rows) == [("ACME", "Q1"), ("ACME", "Q2"), ("ZETA&CO", "Q1"), ("ZETA&CO", "Q2")] and opened() == 8
    assert load(company="none").count() == 0 and opened() == 8
    assert load(quarter="Q2", year=(2023, 2025)).count() == 3 and opened() == 11
    assert load().count() == 12 and opened() == 23
    both = load(company="acme").unionByName(load(company="other", year=2023))
    assert sorted({r["company"] for r in both.collect()}) == ["ACME", "OTHER"]


def test_same_texts_as_the_scan(spark, folder):
    frame = C.calls(spark, str(folder), packBytes="900")
    assert frame.rdd.getNumPartitions() > 3
    old = files.texts(files.scan(spark, str(folder)))
    old = old.withColumn("source_file", F.element_at(F.split("path", "/"), -1)).where("source_file LIKE '%/_Q%' ESCAPE '/'")
    got = {r["source_file"]: (r["text"], r["company"], r["year"]) for r in frame.collect()}
    named = files.split_rejects(old)[0].collect()
    assert got == {r["source_file"]: (r["text"], r["meta"]["company"], r["meta"]["year"]) for r in named} and len(got) == 12
    assert "\n[PAGE_BREAK]\nsecond" in next(iter(got.values()))[0]
    assert frame.select(X.word_count(F.col("text")).alias("n")).where("n < 60").count() == 0


def test_rejects(spark, tmp_path, folder):
    got = C.calls(spark, str(folder), rejects="true").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in got] == [("bad name.pdf", files.NAME_FORM)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert C.calls(spark, str(empty)).count() == 0 and C.calls(spark, str(empty), rejects="true").count() == 0
