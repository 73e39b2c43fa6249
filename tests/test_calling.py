"""Calls under a shared budget, and calls that are answered once whatever is lost."""

from __future__ import annotations

import os
import time

import pytest

from corvane.operators import calling, scoring
from corvane.operators.calling import Ledger, Limits, Request, Window
from corvane.plans import catalog

CALLS = "transcript_id long, dimension string, batch_no int, prompt string"


def prompts(spark, n, size=60):
    return spark.createDataFrame([(i, "overpromising", 0, f"{i:06d}" + "x" * (size - 6)) for i in range(n)], CALLS)


def test_window_keeps_every_stretch_within_the_budget():
    now, sent = [0.0], []
    window = Window(100, 60.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for tokens in (40, 50, 30, 100, 10, 10, 70, 90, 20):
        window.take(tokens)
        sent.append((now[0], tokens))
        now[0] += 1
    assert max(sum(t for at, t in sent if start <= at < start + 60) for start, _ in sent) <= 100
    assert now[0] < 60 * 6
    window.fill()
    began = now[0]
    window.take(1)
    assert now[0] >= began + 60


def test_tasks_share_one_budget(spark, tmp_path):
    """Eight tasks; the scorer notes what it is sent, and no stretch as long as the window exceeds the budget."""
    log, seconds, budget = str(tmp_path / "sent"), 1.5, 8000

    def counting(system, prompt, model, max_tokens):
        with open(log, "a") as f:
            f.write(f"{time.time()} {calling.estimate(system, prompt) + max_tokens}\n")
        return catalog.offline_scorer(system, prompt, model)

    calls = prompts(spark, 60)
    limits = Limits(tokens=budget, seconds=seconds, parallel=8, concurrency=2)
    assert limits.tasks(500) == 8 and limits.tasks(3000) == 2 and limits.tasks(9000) == 1 and Limits().tasks(10**9) == 8
    free = {tuple(r)[:7] for r in scoring.call_model(calls, lambda s, p, m, max_tokens: catalog.offline_scorer(s, p, m), max_tokens=300).collect()}
    held = {tuple(r)[:7] for r in scoring.call_model(calls, counting, limits=limits, max_tokens=300).collect()}
    assert held == free and len(held) == 60
    sent = sorted((float(a), int(b)) for a, b in (line.split() for line in open(log)))
    # the note is written a moment after the request is let through
    assert max(sum(t for at, t in sent if start <= at < start + seconds - 0.2) for start, _ in sent) <= budget
    assert sent[-1][0] - sent[0][0] > seconds


def test_a_request_over_the_budget_is_told_as_data(spark):
    got = scoring.call_model(prompts(spark, 2, 9000), catalog.offline_scorer, limits=Limits(tokens=1000), max_tokens=10).collect()
    assert all("over the budget" in r["error"] and r["raw"] is None for r in got)


def test_temperature_and_token_limit_reach_the_scorer(spark):
    seen = lambda system, prompt, model, **more: f"{model} {sorted(more.items())}"
    got = scoring.call_model(prompts(spark, 1), seen, "m", temperature=0.3, max_tokens=17).first()["raw"]
    assert got == "m [('max_tokens', 17), ('temperature', 0.3)]"
    assert scoring.call_model(prompts(spark, 1), lambda s, p, m, temperature: str(temperature)).first()["raw"] == "0.1"
    assert len({Request("s", "u", "m").key, Request("s", "u", "m", temperature=0.2).key, Request("s", "u", "m", max_tokens=1).key, Request("su", "", "m").key}) == 4


def test_a_lost_task_repeats_only_the_call_under_way(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), Ledger(f"file://{tmp_path}/ledger")

    def dying(system, prompt, model):
        with open(log, "a") as f:
            f.write(prompt[:6] + "\n")
        if prompt.startswith("000013") and not os.path.exists(f"{log}.died"):
            open(f"{log}.died", "w").close()
            os._exit(1)  # the worker goes, and its task with it
        return catalog.offline_scorer(system, prompt, model)

    calls = prompts(spark, 20).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017, PT011 (local masters do not run a task twice)
        scoring.call_model(calls, dying, ledger=ledger).collect()
    first = open(log).read().split()
    assert first == [f"{i:06d}" for i in range(14)]
    got = scoring.call_model(calls, dying, ledger=ledger).collect()
    assert len(got) == 20 and all(r["error"] is None for r in got)
    assert open(log).read().split()[14:] == [f"{i:06d}" for i in range(13, 20)]  # the thirteen that were answered are not asked again
    assert {tuple(r)[:7] for r in got} == {tuple(r)[:7] for r in scoring.call_model(calls, catalog.offline_scorer).collect()}


def test_errors_are_not_kept(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "ledger"))

    def broken(*_):
        raise RuntimeError("down")

    assert scoring.call_model(prompts(spark, 1), broken, ledger=ledger).first()["error"] == "down"
    assert scoring.call_model(prompts(spark, 1), catalog.offline_scorer, ledger=ledger).first()["error"] is None
    assert ledger.get("0" * 64) is None


def test_a_ledger_that_cannot_be_written_fails_the_task(spark, tmp_path):
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception, match="LedgerError"):
        scoring.call_model(prompts(spark, 1), catalog.offline_scorer, ledger=Ledger(f"{tmp_path}/file/ledger")).collect()
