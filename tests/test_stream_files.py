"""A growing folder of files: new ones, copies, files that failed, files that are gone, bytes written."""

import os

import pytest
from pyspark.sql import functions as F

from specmill.operators.journal import ReplyJournal
from specmill.sources.tables import PartLog, ledger_table
from specmill.streaming.incremental import PENDING_NAMES, start_files
from tests.test_jobs import SHEET, Scripted


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def pages(blob):
    return blob.decode().split("\f")


def test_a_folder_in_three_steps(spark, rules, good, tmp_path, calls):
    folder, root, seen = tmp_path / "in", str(tmp_path / "t"), []
    folder.mkdir()

    def run(**model):
        del seen[:]
        start_files(
            spark, str(folder), pages, root, rules, Scripted(good, calls, **model),
            on_outcomes=lambda df, n: seen.append((n, sorted((os.path.basename(r.source_file), r.outcome) for r in df.collect()))),
        ).awaitTermination()
        return seen

    (folder / "a.pdf").write_text(SHEET % "A")
    (folder / "note.txt").write_text(SHEET % "N")
    (folder / "blank.pdf").write_text("\f")
    assert run() == [(0, [("a.pdf", "stored"), ("blank.pdf", "skipped")])]
    (folder / "late.pdf").write_text(SHEET % "LATE")
    (folder / "renamed.pdf").write_text(SHEET % "A")
    before = len(list(calls.iterdir()))
    assert run(broken={"LATE"}) == [(1, [("late.pdf", "failed"), ("renamed.pdf", "unchanged")])]
    assert len(list(calls.iterdir())) == before + 3
    assert [os.path.basename(r[0]) for r in PartLog(spark, f"{root}/pending", PENDING_NAMES).read().collect()] == ["late.pdf"]
    # What failed comes first, whether files are new or not; a file that is gone is not offered for good.
    assert run() == [(-1, [("late.pdf", "stored")])]
    assert run() == []
    (folder / "x.pdf").write_text(SHEET % "X")
    run(broken={"X"})
    (folder / "x.pdf").unlink()
    assert run() == [(-1, [("x.pdf", "failed")])] and run() == []
    files = {os.path.basename(r.source_file): r.outcome for r in ledger_table(spark, root).read().collect()}
    assert files == {"a.pdf": "stored", "blank.pdf": "skipped", "late.pdf": "stored", "x.pdf": "failed"}
    assert ReplyJournal(spark, root).replies().select("source_hash").distinct().count() <= 1


def test_waiting_files_are_written_once_each(spark, rules, good, tmp_path, calls):
    folder, root, written = tmp_path / "in", str(tmp_path / "t"), []
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.pdf").write_text(SHEET % ("Q" if i == 0 else f"P{i}"))
        os.utime(folder / f"{i}.pdf", (1_700_000_000 + i, 1_700_000_000 + i))

    def note(outcomes, number):
        parts = sorted(os.listdir(f"{root}/pending"))
        written.append((number, len(parts)))

    start_files(
        spark, str(folder), pages, root, rules, Scripted(good, calls, quota={"Q"}), files_per_batch=1, on_outcomes=note
    ).awaitTermination()
    # A part of one name per micro-batch, and one call in all.
    assert written == [(i, i + 1) for i in range(5)] and len(list(calls.iterdir())) == 1
    log = PartLog(spark, f"{root}/pending", PENDING_NAMES)
    assert log.read().count() == 5 and "content" not in PENDING_NAMES.names
    log.compact(log.read().where(F.col("source_file").endswith("0.pdf")))
    assert log.read().count() == 1 and len(os.listdir(f"{root}/pending")) == 1


def test_the_source_opens_no_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("source_file"))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
