"""Whole runs with scripted models: outcomes, ledger, retries, quota, force, streams."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from specmill.operators.ledger import outcome_line, run_failed, run_summary, with_history
from specmill.operators.scoring import scored
from specmill.plans.batch import RunOptions, run_paths, run_texts
from specmill.session import shared_folder
from specmill.sources.files import discover, fingerprint, fingerprinted, in_arrival_order
from specmill.sources.pages import paginate, without_text
from specmill.sources.tables import exported, imported, ledger_table, record_table
from specmill.streaming.incremental import start_incremental

SHEET = "Technical data of part %s\nOperating voltage 18...32 V DC, output 4...20 mA"


class Scripted:
    """Answers by the sheet's text; notes every call in a folder."""

    def __init__(self, reply, folder, broken=(), quota=()):
        self.reply, self.folder, self.broken, self.quota = reply, folder, broken, quota

    def __call__(self):
        return self

    def complete(self, prompt):
        part = prompt.split("Technical data of part ", 1)[1].split("\n", 1)[0]
        (Path(self.folder) / f"{part}-{len(list(Path(self.folder).iterdir()))}").write_text(prompt)
        if part in self.quota:
            raise RuntimeError("429 RESOURCE_EXHAUSTED: quota exceeded")
        return "nope" if part in self.broken else json.dumps({**self.reply, "part_number": part})


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def documents(spark, names):
    """Table input; a name without letters is a sheet without text."""
    rows = [(i, f"in/{n}-{i}.pdf", SHEET % n if n.strip("_") else n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "seq long, source_file string, text string")
    return paginate(df.withColumn("source_hash", fingerprint(F.col("text"))), separator="\f")


def outcomes(df):
    return [(r["outcome"], r["record_id"]) for r in df.orderBy("seq").collect()]


def test_run_stores_skips_fails_and_rerun_does_nothing(spark, rules, good, tmp_path, calls):
    names = ["A", "__", "B", "A", "BAD", "BAD", "__"]
    model = Scripted(good, calls, broken={"BAD"})
    root = str(tmp_path / "t")
    first = run_texts(documents(spark, names), root, rules, model)
    assert outcomes(first) == [
        ("stored", 1), ("skipped", None), ("stored", 2), ("unchanged", 1), ("failed", None), ("failed", None),
        ("unchanged", None),
    ]
    assert len(list(calls.iterdir())) == 1 + 1 + 3
    rows = {r["seq"]: r for r in first.collect()}
    assert "3 attempt(s)" in rows[4]["reason"] and "scanned" in rows[1]["reason"]
    assert rows[3]["reason"] == "already stored" and rows[0]["status"] == "ok"
    summary = run_summary(first)
    assert [r["files"] for r in summary.orderBy("position").collect()] == [2, 1, 2, 0, 2]
    assert run_failed(summary).first()[0]
    lines = [r[0] for r in first.orderBy("seq").select(outcome_line()).collect()]
    assert lines[0] == f"{'A-0.pdf':<36} {'stored':<10} {'ok':<8} {'A':<18} 0 problem(s)"

    again = run_texts(documents(spark, names), root, rules, Scripted(good, calls))
    assert [o for o, _ in outcomes(again)] == ["unchanged"] * 4 + ["stored", "unchanged", "unchanged"]
    assert len(list(calls.iterdir())) == 6
    records = record_table(spark, root, rules).read()
    assert sorted((r["id"], r["part_number"]) for r in records.collect()) == [(1, "A"), (2, "B"), (3, "BAD")]
    ledger = {r["source_file"]: r["outcome"] for r in ledger_table(spark, root).read().collect()}
    assert ledger == {"in/A-0.pdf": "stored", "in/__-1.pdf": "skipped", "in/B-2.pdf": "stored", "in/BAD-4.pdf": "stored"}
    back = imported(exported(records, rules), rules)
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))


def test_quota_defers_every_later_path(spark, rules, good, tmp_path, calls):
    root = str(tmp_path / "t")
    run_texts(documents(spark, ["A"]), root, rules, Scripted(good, calls))
    names = ["B", "Q", "A", "C", "Q"]
    got = run_texts(documents(spark, names), root, rules, Scripted(good, calls, quota={"Q"}))
    assert [o for o, _ in outcomes(got)] == ["stored", "failed", "deferred", "deferred", "deferred"]
    assert "quota" in got.where("seq = 1").first()["reason"]
    assert {r["source_file"] for r in ledger_table(spark, root).read().collect()} == {
        "in/A-0.pdf", "in/B-0.pdf", "in/Q-1.pdf",
    }


def test_force_processes_again_and_keeps_ids(spark, rules, good, tmp_path, calls):
    root = str(tmp_path / "t")
    run_texts(documents(spark, ["A", "B"]), root, rules, Scripted(good, calls))
    forced = RunOptions(force=True)
    got = run_texts(documents(spark, ["B", "A", "B"]), root, rules, Scripted({**good, "weight": 5}, calls), forced)
    assert outcomes(got) == [("stored", 2), ("stored", 1), ("stored", 2)]
    rows = {r["id"]: r for r in record_table(spark, root, rules).read().collect()}
    assert rows[2]["source_file"] == "in/B-2.pdf" and rows[1]["status"] == "warning" and len(rows) == 2


def test_waves_stop_after_quota(spark, rules, good, calls):
    rows = [(f"h{i}", i * 10, SHEET % ("Q" if i == 2 else f"P{i}")) for i in range(8)]
    df = spark.createDataFrame(rows, "source_hash string, seq long, excerpt string")
    attempts = scored(df, rules, Scripted(good, calls, quota={"Q"}), wave=10)
    assert sorted((r["seq"], r["error"] is None) for r in attempts.collect()) == [(0, True), (10, True), (20, False)]
    with pytest.raises(ValueError):
        scored(df, rules, Scripted(good, calls), max_attempts=0)


def test_files_on_disk(spark, rules, good, tmp_path, calls):
    folder = tmp_path / "sheets"
    (folder / "deeper").mkdir(parents=True)
    for name, part in (("b.pdf", "B"), ("a.pdf", "A"), ("copy.pdf", "A"), ("x.PDF", "X"), ("deeper/d.pdf", "D")):
        (folder / name).write_text(SHEET % part)
    (folder / "blank.pdf").write_text("\f  \f")
    (tmp_path / "single.txt").write_text(SHEET % "S")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\xff")
    paths = [str(folder), str(tmp_path / "single.txt"), str(tmp_path / "gone.pdf"), str(tmp_path / "bad.bin")]
    listed = in_arrival_order(fingerprinted(discover(spark, paths))).orderBy("seq").collect()
    assert [(r["seq"], r["source_file"].rsplit("/", 1)[1]) for r in listed] == list(
        enumerate(["a.pdf", "b.pdf", "blank.pdf", "copy.pdf", "single.txt", "gone.pdf", "bad.bin"])
    )
    assert len(listed[0]["source_hash"]) == 64 and listed[0]["source_hash"] == listed[3]["source_hash"]
    # Files are read in pieces, so no limit on what a row may hold matters; and no bytes are shuffled.
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "10")
    try:
        again = fingerprinted(discover(spark, paths * 20))
        hashes = {(r["source_file"], r["source_hash"]) for r in again.collect()}
    finally:
        spark.conf.unset(limit)
    assert hashes == {(r["source_file"], r["source_hash"]) for r in listed}
    plan = again._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan binaryFile") <= 2 and "content" not in plan

    got = run_paths(
        spark, paths, lambda blob: blob.decode().split("\f"), str(tmp_path / "t"), rules, Scripted(good, calls)
    )
    rows = got.orderBy("seq").collect()
    assert [r["outcome"] for r in rows] == ["stored", "stored", "skipped", "unchanged", "stored", "failed", "failed"]
    assert "across 3 page(s)" in rows[2]["reason"] and rows[2]["reason"].startswith("blank.pdf: only 0 ")
    assert rows[5]["reason"].startswith("FileNotFoundError") and rows[6]["reason"].startswith("UnicodeDecodeError")


def test_every_path_has_one_outcome_when_the_quota_ends_in_the_middle(spark, rules, good, tmp_path, calls):
    names = [f"D{i}" if i != 170 else "Q" for i in range(300)]
    names[250] = names[3]
    names[100] = names[4]
    options = RunOptions(wave=64, tasks=5)
    shared = shared_folder(spark)
    before = set(os.listdir(shared))
    got = run_texts(documents(spark, names), str(tmp_path / "t"), rules, Scripted(good, calls, quota={"Q"}), options)
    want = [("stored" if i < 170 else "failed" if i == 170 else "deferred") for i in range(300)]
    want[100] = "unchanged"
    assert [r["outcome"] for r in got.orderBy("seq").collect()] == want
    counts = {r["outcome"]: r["files"] for r in run_summary(got).collect()}
    assert counts == {"stored": 169, "skipped": 0, "failed": 1, "deferred": 129, "unchanged": 1}
    # Nothing but the outcomes is left of what the run wrote in between.
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - before] == ["outcomes"]


def test_stream_offers_failed_and_deferred_files_again(spark, rules, good, tmp_path, calls):
    source, root, seen = str(tmp_path / "in"), str(tmp_path / "t"), []
    for part in (["A", "Q", "B"], ["C", "A"]):
        rows = [(f"in/{n}{len(part)}.pdf", SHEET % n) for n in part]
        spark.createDataFrame(rows, "source_file string, text string").coalesce(1).write.mode("append").json(source)

    def run(**model):
        stream = spark.readStream.schema("source_file string, text string").option("maxFilesPerTrigger", 1).json(source)
        stream = paginate(stream.withColumn("source_hash", fingerprint(F.col("text"))), separator="\f")
        del seen[:]
        start_incremental(
            stream, root, rules, Scripted(good, calls, **model), str(tmp_path / "cp"),
            on_outcomes=lambda df, n: seen.append((n, sorted((r["source_file"], r["outcome"]) for r in df.collect()))),
        ).awaitTermination()

    run(quota={"Q"})
    first, second = sorted(seen)
    if dict(first[1]).get("in/Q3.pdf") == "failed":
        # The quota ended in the first micro-batch: nothing of the second is looked at.
        assert first[1] == [("in/A3.pdf", "stored"), ("in/B3.pdf", "stored"), ("in/Q3.pdf", "failed")]
        assert second[1] == [("in/A2.pdf", "deferred"), ("in/C2.pdf", "deferred")]
    run()
    assert seen[0][0] == -1 and len(seen) == 1
    assert ("in/Q3.pdf", "stored") in seen[0][1]
    run()
    assert seen == []
    parts = {r["part_number"] for r in record_table(spark, root, rules).read().collect()}
    assert parts == {"A", "B", "C", "Q"}


def test_stream_processes_each_content_once(spark, rules, good, tmp_path, calls):
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    seen = []

    def step(names, start):
        rows = [(f"in/{start + i}.pdf", SHEET % n) for i, n in enumerate(names)]
        spark.createDataFrame(rows, "source_file string, text string").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("source_file string, text string").json(source)
        stream = paginate(stream.withColumn("source_hash", fingerprint(F.col("text"))), separator="\f")
        start_incremental(
            stream, root, rules, Scripted(good, calls, broken={"LATE"} if start == 0 else ()), str(tmp_path / "cp"),
            on_outcomes=lambda df, n: seen.append([r["outcome"] for r in df.orderBy("seq").collect()]),
        ).awaitTermination()

    step(["A", "B", "LATE"], 0)
    step(["A", "C", "LATE"], 10)
    # The second run begins with the file that failed.
    assert seen == [["stored", "stored", "failed"], ["stored"], ["unchanged", "stored", "unchanged"]]
    assert record_table(spark, root, rules).read().count() == 4


def test_short_documents_are_explained(spark):
    df = spark.createDataFrame([("d/a.pdf", ["  x ", ""]), ("b.pdf", ["y" * 20])], "source_file string, pages array<string>")
    rows = without_text(df).collect()
    assert rows[0]["skip_reason"].startswith("a.pdf: only 4 characters of text across 2 page(s).")
    assert rows[1]["skip_reason"] is None


def test_a_short_run_reads_a_long_ledger_without_a_shuffle(spark, tmp_path):
    ledger = spark.range(300_000).selectExpr("sha2(cast(id as string), 256) source_hash", "if(id % 3 = 0, 'failed', 'stored') outcome", "id record_id")
    ledger.write.parquet(f"{tmp_path}/ledger")
    few = spark.range(299_990, 300_010).selectExpr("sha2(cast(id as string), 256) source_hash", "id seq")
    few.write.parquet(f"{tmp_path}/contents")
    known = with_history(spark.read.parquet(f"{tmp_path}/contents"), spark.read.parquet(f"{tmp_path}/ledger"))
    got = {r.seq: (r.old_outcome, r.old_id, r.todo) for r in known.collect()}
    want = {n: (None, None, True) if n >= 300_000 else ("failed", n, True) if n % 3 == 0 else ("stored", n, False) for n in range(299_990, 300_010)}
    assert got == want
    lines = known._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = lines[: next((i for i, line in enumerate(lines) if "Initial Plan" in line), len(lines))]
    # From the semi-join down to the ledger's scan nothing is shuffled.
    start = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert "BroadcastHashJoin" in lines[start]
    assert not any("Exchange hashpartitioning" in line for line in lines[start:])
