"""Names of a growing folder: what the listing takes, what a stream over it has had, what the driver holds."""

import glob
import os

import pytest
from pyspark.errors import AnalysisException

from specmill.sources.files import listed
from specmill.streaming.incremental import _new_names, start_files
from tests.test_jobs import Scripted


def put(folder, *names):
    for name in names:
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as file:
            file.write("\f")


def below(rows, folder):
    return sorted(r.source_file.removeprefix(f"file:{folder}/") for r in rows.collect())


def test_the_source_sees_few_files_of_names(spark, rules, good, tmp_path):
    folder, root, seen = f"{tmp_path}/in", f"{tmp_path}/t", []
    put(folder, *(f"{i:03d}.pdf" for i in range(40)))
    start_files(
        spark, folder, lambda blob: blob.decode().split("\f"), root, rules, Scripted(good, tmp_path),
        on_outcomes=lambda df, n: seen.extend((r.source_file, r.outcome) for r in df.collect()),
    ).awaitTermination()
    assert sorted(seen) == [(f"file:{folder}/{i:03d}.pdf", "skipped" if i == 0 else "unchanged") for i in range(40)]
    logs = glob.glob(f"{root}/stream/**/sources/0/[0-9]*", recursive=True)
    with open(logs[0]) as log:
        entries = log.read().splitlines()[1:]
    # Spark holds its source's log, and what it lists, on the driver: files of names, not the 40 names.
    assert len(logs) == 1 and 1 <= len(entries) <= 4


def test_the_listing_takes_what_sparks_source_takes(spark, tmp_path):
    shown = ["x.pdf", "_k=1.pdf", "sp ace.pdf", "a^b.pdf", "ümlaut.pdf", "k=1/j=2/z.pdf"]
    put(f"{tmp_path}/a", *shown, "_h.pdf", ".h.pdf", "c.PDF", "z.pdf._COPYING_", "note.txt", "sub/y.pdf", "dir.pdf/q.pdf")
    put(f"{tmp_path}/b", "y.pdf")
    os.symlink(f"{tmp_path}/a/x.pdf", f"{tmp_path}/a/link.pdf")
    os.symlink(f"{tmp_path}/a/none", f"{tmp_path}/a/dead.pdf")
    os.symlink(f"{tmp_path}/a/sub", f"{tmp_path}/a/folder.pdf")
    assert below(listed(spark, f"{tmp_path}/a"), f"{tmp_path}/a") == sorted([*shown, "link.pdf"])
    assert below(listed(spark, f"{tmp_path}/a", "{x,a}*.pdf"), f"{tmp_path}/a") == ["a^b.pdf", "x.pdf"]
    assert below(listed(spark, f"{tmp_path}/?", "[!a-w]*.pdf"), tmp_path) == [
        "a/_k=1.pdf", "a/k=1/j=2/z.pdf", "a/x.pdf", "a/ümlaut.pdf", "b/y.pdf"
    ]
    assert below(listed(spark, f"{tmp_path}/none*"), tmp_path) == []
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        listed(spark, f"{tmp_path}/none")


def test_each_name_is_offered_once_and_the_oldest_first(spark, tmp_path):
    folder, place = f"{tmp_path}/in", f"{tmp_path}/names"

    def run(per_batch=None):
        got = []
        stream = _new_names(listed(spark, folder), place, per_batch).writeStream
        stream = stream.foreachBatch(lambda batch, number: got.append(below(batch, folder)))
        stream.option("checkpointLocation", f"{tmp_path}/batches").trigger(availableNow=True).start().awaitTermination()
        return got

    put(folder, "note.txt")
    assert run() == []
    for age, name in enumerate("gfedcba"):
        put(folder, f"{name}.pdf")
        os.utime(f"{folder}/{name}.pdf", (1_600_000_000 + age, 1_600_000_000 + age))
    assert run(3) == [["e.pdf", "f.pdf", "g.pdf"], ["b.pdf", "c.pdf", "d.pdf"], ["a.pdf"]]
    # A run that dies has added its names, and the next one offers them, with what is new since.
    put(folder, "h.pdf")
    _new_names(listed(spark, folder), place, None)
    # Older than the rest by years, but not offered yet.
    put(folder, "old.pdf")
    os.utime(f"{folder}/old.pdf", (1_000_000_000, 1_000_000_000))
    put(folder, "a.pdf")
    assert run() == [["h.pdf", "old.pdf"]]
    assert run() == []
