"""Calls are paid once: the reply journal, calls in flight, the stop after a quota error."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import specmill.plans.batch as batch
from specmill.operators.journal import ReplyJournal
from specmill.operators.scoring import scored
from specmill.plans.batch import RunOptions, run_texts
from tests.test_jobs import SHEET, documents, outcomes


class Counting:
    """Answers by the sheet's text, and notes every call as an empty file: part, whether it is a retry, a time."""

    def __init__(self, reply, folder, quota=(), slow=0.0, first_fails=(), never=()):
        self.reply, self.folder, self.quota, self.slow = reply, folder, quota, slow
        self.first_fails, self.never = first_fails, never

    def __call__(self):
        return self

    def complete(self, prompt):
        part = prompt.split("Technical data of part ", 1)[1].split("\n", 1)[0]
        again = prompt.rstrip().endswith('"""') is False
        (Path(self.folder) / f"{part}~{int(again)}~{time.time_ns()}").touch()
        time.sleep(self.slow)
        if (part, again) in self.quota:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        if part in self.never or (part in self.first_fails and not again):
            return "nope"
        return json.dumps({**self.reply, "part_number": part})


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def made(calls):
    return sorted(tuple(p.name.split("~")[:2]) for p in calls.iterdir())


def test_a_run_after_a_quota_error_pays_for_nothing_twice(spark, rules, good, tmp_path, calls):
    root, names = str(tmp_path / "t"), [f"D{i:02d}" for i in range(12)]
    # D03 is answered at the second try only, and that try meets the quota; later ones are in flight by then.
    model = Counting(good, calls, quota={("D03", True)}, slow=0.2, first_fails={"D03"})
    first = run_texts(documents(spark, names), root, rules, model, RunOptions(tasks=1, in_flight=6))
    assert [o for o, _ in outcomes(first)] == ["stored"] * 3 + ["failed"] + ["deferred"] * 8
    before = made(calls)
    assert ("D04", "0") in before and ("D03", "1") in before and ("D11", "0") not in before
    second = run_texts(documents(spark, names), root, rules, Counting(good, calls, first_fails={"D03"}))
    assert [o for o, _ in outcomes(second)] == ["unchanged"] * 3 + ["stored"] * 9
    # Only the call that failed was made again.
    assert made(calls) == sorted([(n, "0") for n in names] + [("D03", "1")] * 2)
    assert ReplyJournal(spark, root).replies().count() == 0


def test_a_run_that_dies_leaves_its_replies(spark, rules, good, tmp_path, calls, monkeypatch):
    root, names = str(tmp_path / "t"), ["A", "B", "C"]

    def broken(*_):
        raise RuntimeError("the machine is gone")

    with monkeypatch.context() as patch:
        patch.setattr(batch, "validated", broken)
        with pytest.raises(RuntimeError, match="machine"):
            run_texts(documents(spark, names), root, rules, Counting(good, calls))
    assert len(made(calls)) == 3
    got = run_texts(documents(spark, names), root, rules, Counting(good, calls))
    assert [o for o, _ in outcomes(got)] == ["stored"] * 3 and len(made(calls)) == 3


def test_used_up_attempts_begin_anew_and_force_asks_again(spark, rules, good, tmp_path, calls):
    root = str(tmp_path / "t")
    run_texts(documents(spark, ["A", "B"]), root, rules, Counting(good, calls, never={"A"}))
    assert made(calls) == [("A", "0"), ("A", "1"), ("A", "1"), ("B", "0")]
    got = run_texts(documents(spark, ["A", "B"]), root, rules, Counting(good, calls))
    assert [o for o, _ in outcomes(got)] == ["stored", "unchanged"] and len(made(calls)) == 5
    run_texts(documents(spark, ["A", "B"]), root, rules, Counting(good, calls), RunOptions(force=True))
    assert len(made(calls)) == 7


def test_calls_in_flight_in_one_task(spark, rules, good, calls):
    rows = [(f"h{i}", i, SHEET % f"P{i}") for i in range(32)]
    df = spark.createDataFrame(rows, "source_hash string, seq long, excerpt string").coalesce(1)
    one = scored(df, rules, Counting(good, calls, first_fails={"P5"}), tasks=1).orderBy("seq", "attempt").collect()
    for path in calls.iterdir():
        path.unlink()
    many = scored(df, rules, Counting(good, calls, slow=1.0, first_fails={"P5"}), tasks=1, in_flight=32, per_task=32)
    assert many.orderBy("seq", "attempt").collect() == one and len(one) == 33
    stamps = sorted(int(p.name.split("~")[2]) for p in calls.iterdir())
    # All first calls begin within the time of one.
    assert (stamps[31] - stamps[0]) / 1e9 < 1.0
    with pytest.raises(ValueError):
        scored(df, rules, Counting(good, calls), in_flight=0)


def test_other_tasks_stop_after_a_quota_error(spark, rules, good, calls):
    rows = [(f"h{i}", i, SHEET % f"P{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "source_hash string, seq long, excerpt string")
    attempts = scored(df, rules, Counting(good, calls, quota={("P002", False)}, slow=0.3), tasks=4, per_task=50).collect()
    last = max(int(p.name.split("~")[2]) for p in calls.iterdir() if p.name.startswith("P002")) + 0.3e9
    after = [p.name for p in calls.iterdir() if int(p.name.split("~")[2]) > last + 0.2e9]
    assert len(after) <= 4 and len(made(calls)) < 40
    assert {r.seq for r in attempts} >= {0, 1, 2} and [r.seq for r in attempts if r.error] == [2]
