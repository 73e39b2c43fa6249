"""Settings from a file, and the one-file report."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.settings import Settings
from corvane.sources import files
from corvane.sources.report import write_report


def test_settings(tmp_path):
    place = tmp_path / "s.toml"
    place.write_text('store = "/s"\nmodel = "m"\ntokens_per_minute = 8000\nchunk_words = 50\n')
    found = Settings.load(str(place)).over(model="n", company="x", parallel=None)
    assert (found.store, found.model, found.parallel, found.chunk_words) == ("/s", "n", 8, 50)
    assert found.limits.tokens == 8000 and Settings().limits is None and found.calling["temperature"] == 0.1
    place.write_text("colour = 1\n")
    with pytest.raises(ValueError, match="colour"):
        Settings.load(str(place))
    with pytest.raises(SystemExit):
        cli.main(["check"])


def test_report(spark, tmp_path):
    place = tmp_path / "r.json"
    frames = {"a": spark.range(1000, numPartitions=7).selectExpr("id", "CASE WHEN id = 3 THEN NULL ELSE 'ä\"\n' END AS s"), "none": spark.range(0).select("id"), "b": spark.range(5).orderBy(F.desc("id"))}
    for _ in range(2):  # a report replaces the one before
        write_report(frames, str(place))
        got = json.loads(place.read_text())
        assert [r["id"] for r in got["a"]] == list(range(1000)) and got["a"][3]["s"] is None and got["a"][0]["s"] == 'ä"\n'
        assert got["none"] == [] and [r["id"] for r in got["b"]] == [4, 3, 2, 1, 0]
    assert list(tmp_path.iterdir()) == [place]


def test_a_failed_report_leaves_nothing(spark, tmp_path):
    failing = spark.range(100, numPartitions=3).select(F.when(F.col("id") == 99, F.raise_error(F.lit("bad row"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="bad row"):
        write_report({"a": failing}, str(tmp_path / "r.json"))
    assert list(tmp_path.iterdir()) == []


def test_rejects_are_all_kept(spark, tmp_path, monkeypatch, caplog):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"bad {i}.pdf").write_text("x " * 60)
    (folder / "acme_Q1_2024.pdf").write_text("short")
    (folder / "acme_Q2_2024.pdf").write_text("Word here. " * 60)
    monkeypatch.setattr(cli, "SHOWN", 3)
    totals = cli.main(["ingest", str(folder), "--store", f"{tmp_path}/store"], spark)
    assert totals["documents"] == 1 and totals["rejected"] == 8
    kept = spark.read.parquet(f"{tmp_path}/store/rejects").groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in kept} == {files.NAME_FORM: 7, files.TOO_SHORT: 1}
    said = [r.getMessage() for r in caplog.records]
    assert sum(m.startswith("Skipped") for m in said) == 3 and "These were 3 of 8" in said
