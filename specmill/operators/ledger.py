"""The processed-file ledger and the outcome of every path of a run.

Each content hash is processed once per run. All paths with that content then read
their outcome from the one result, so a third of all paths being copies of one file costs one
document's work and a spread lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.functions.spread import spread_left_join
from specmill.functions.text import base_name

# Fixed values, in report order.
OUTCOMES = ("stored", "skipped", "failed", "deferred", "unchanged")
DEFERRED_REASON = "API quota exhausted; run again later"


def first_copies(files: DataFrame) -> DataFrame:
    """One row per content: (source_hash, seq, source_file, last_seq, last_file, copies).

    ``seq`` and ``source_file`` are those of the first path in arrival order. The aggregate
    combines before the shuffle, so hot contents are no hot groups.
    """
    return files.groupBy("source_hash").agg(
        F.min("seq").alias("seq"),
        F.min_by("source_file", "seq").alias("source_file"),
        F.max("seq").alias("last_seq"),
        F.max_by("source_file", "seq").alias("last_file"),
        F.count("*").alias("copies"),
    )


def with_history(contents: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Adds what the ledger says: ``old_outcome``, ``old_id`` and ``todo``.

    The ledger is cut down to the given contents first: where these are small enough to broadcast, by Spark's own
    check of their size, a ledger of any length is read without a shuffle. Otherwise both joins share one.
    """
    known = ledger.select(
        "source_hash", F.col("outcome").alias("old_outcome"), F.col("record_id").alias("old_id")
    ).join(contents.select("source_hash"), "source_hash", "left_semi")
    settled_before = F.col("old_outcome").isNotNull() & (F.col("old_outcome") != "failed")
    return contents.join(known, "source_hash", "left").withColumn(
        "todo", F.lit(True) if force else ~settled_before
    )


def unseen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger does not settle: new contents and contents that failed before."""
    return files.join(ledger.where(F.col("outcome") != "failed"), "source_hash", "left_anti")


def first_quota_seq(results: DataFrame) -> Column:
    """Arrival number of the first content whose call hit the quota, as a scalar subquery."""
    return results.where("quota").agg(F.min("seq").alias("seq")).scalar()


def path_outcomes(files: DataFrame, contents: DataFrame, cutoff: Column, force: bool = False) -> DataFrame:
    """One row per path: outcome, reason, record id, status, part number, problem count.

    ``contents`` holds per hash ``seq``, ``todo``, the ledger's view and, for contents that
    were processed, ``outcome``, ``reason``, ``record_id``, ``status``, ``part_number``,
    ``problem_count``. Paths after ``cutoff`` are deferred, known or not. A later copy of a
    content stored or skipped in this run is unchanged; of a failed one it fails alike.
    """
    looked_up = contents.withColumnRenamed("seq", "first_seq").select(
        "source_hash", "first_seq", "todo", "old_outcome", "old_id", "outcome", "reason", "record_id",
        "status", "part_number", "problem_count",
    )
    rows = spread_left_join(files, looked_up, "source_hash", F.col("seq"))
    deferred = F.coalesce(F.col("seq") > cutoff, F.lit(False))
    repeated = (F.col("seq") > F.col("first_seq")) & (F.col("outcome") != "failed") & F.lit(not force)
    unchanged = ~F.col("todo") | F.coalesce(repeated, F.lit(False))
    done = ~deferred & ~unchanged
    already = F.when(F.col("todo"), F.col("outcome")).otherwise(F.col("old_outcome"))
    held_id = F.when(F.col("todo"), F.col("record_id")).otherwise(F.col("old_id"))
    return rows.select(
        "seq",
        "source_file",
        "source_hash",
        F.when(deferred, "deferred").when(unchanged, "unchanged").otherwise(F.col("outcome")).alias("outcome"),
        F.when(deferred, DEFERRED_REASON)
        .when(unchanged, F.concat(F.lit("already "), already))
        .otherwise(F.col("reason"))
        .alias("reason"),
        F.when(~deferred, F.when(unchanged, held_id).otherwise(F.col("record_id"))).alias("record_id"),
        F.when(done, F.col("status")).alias("status"),
        F.when(done, F.col("part_number")).alias("part_number"),
        F.when(done, F.coalesce("problem_count", F.lit(0))).otherwise(F.lit(0)).alias("problem_count"),
    )


def merged_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with ``entries`` (at most one per hash) replacing whole rows."""
    columns = ledger.columns
    both = ledger.withColumn("_new", F.lit(0)).unionByName(entries.select(*columns).withColumn("_new", F.lit(1)))
    newest = both.groupBy("source_hash").agg(
        F.max_by(F.struct(*[c for c in columns if c != "source_hash"]), "_new").alias("_row")
    )
    return newest.select("source_hash", "_row.*").select(*columns)


def ledger_listing(ledger: DataFrame) -> DataFrame:
    """All entries by time and file."""
    return ledger.orderBy("processed_at", "source_file")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(position, outcome, files): all five outcomes in report order, zeros included."""
    spark: SparkSession = outcomes.sparkSession
    kinds = reduce(
        DataFrame.unionByName,
        [
            spark.range(1).select(F.lit(i).alias("position"), F.lit(kind).alias("outcome"))
            for i, kind in enumerate(OUTCOMES)
        ],
    )
    counted = outcomes.groupBy("outcome").agg(F.count("*").alias("files"))
    return kinds.join(counted, "outcome", "left").select(
        "position", "outcome", F.coalesce("files", F.lit(0)).alias("files")
    )


def run_failed(summary: DataFrame) -> DataFrame:
    """One row: whether any file failed or was deferred."""
    bad = F.when(F.col("outcome").isin("failed", "deferred"), F.col("files"))
    return summary.agg((F.coalesce(F.sum(bad), F.lit(0)) > 0).alias("incomplete"))


def outcome_line() -> Column:
    """Report line of a path: name, outcome and detail in fixed widths. Fixed format."""
    stored = F.format_string(
        "%-8s %-18s %d problem(s)",
        F.col("status"),
        F.when(F.coalesce(F.col("part_number"), F.lit("")) == "", "?").otherwise(F.col("part_number")),
        F.col("problem_count"),
    )
    detail = F.when(F.col("outcome") == "stored", stored).otherwise(F.coalesce("reason", F.lit("")))
    return F.format_string("%-36s %-10s %s", base_name(F.col("source_file")), F.col("outcome"), detail)
