"""The batch job over a growing folder or table, one micro-batch at a time.

The ledger is the state: contents are recognised by their hash, so renamed files do no
work. Files that failed or were deferred are added to a pending log, because the source's checkpoint moves past
them; every run begins with them, whether new files have arrived or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from specmill.operators.ledger import DEFERRED_REASON
from specmill.operators.replies import QUOTA_REASON, TextModel
from specmill.plans.batch import PageLoader, RunOptions, page_reader, run_files
from specmill.session import scratch_scope, settled
from specmill.sources.files import DOCUMENT_GLOB, NAMES, fingerprinted, in_arrival_order, listed
from specmill.sources.rules import RuleSet
from specmill.sources.tables import PartLog

PENDING = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("pages", T.ArrayType(T.StringType())),
    ]
)
PENDING_NAMES = T.StructType([T.StructField("source_file", T.StringType())])

OnOutcomes = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Arrivals:
    """How the rows of a stream become files, and their contents pages; ``key`` names a row that has to wait."""

    key: list[str]
    schema: T.StructType
    files: Callable[[DataFrame], DataFrame]
    pages: Callable[[DataFrame], PageLoader]


def start_incremental(
    stream: DataFrame,
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    checkpoint: str | None = None,
    options: RunOptions = RunOptions(),
    on_outcomes: OnOutcomes | None = None,
) -> StreamingQuery:
    """Run the pending files and every available micro-batch of ``stream`` (source_file, source_hash, pages), then stop.

    ``on_outcomes`` receives each batch's outcome rows; the batch of pending files has number -1. A quota error ends the
    model calls of the whole run: what arrives in later micro-batches is deferred, and is pending for the next run. A batch
    that is run again after a crash finds its files in the ledger and leaves the tables as they are.
    """

    def files_of(batch: DataFrame) -> DataFrame:
        # Only names and hashes are sorted; page texts are read again for unsettled contents.
        files = in_arrival_order(batch.select(F.lit(0).alias("argument"), "source_file", "source_hash"))
        return files.select("seq", "source_file", "source_hash", F.lit(None).cast("string").alias("error"))

    def pages_of(batch: DataFrame) -> PageLoader:
        def load_pages(todo: DataFrame) -> DataFrame:
            keys = ["source_file", "source_hash"]
            wanted = batch.join(todo.select(*keys), keys, "left_semi")
            return wanted.select(
                "source_hash", "source_file", "pages", F.lit(None).cast("string").alias("error")
            ).dropDuplicates(["source_hash"])

        return load_pages

    arrivals = Arrivals(["source_file", "source_hash"], PENDING, files_of, pages_of)
    place = checkpoint or f"{root}/stream"
    return _started(stream.sparkSession, lambda: stream, arrivals, root, rules, make_client, place, options, on_outcomes)


def start_files(
    spark: SparkSession,
    folder: str,
    read_pages: Callable[[bytes], list[str]],
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    checkpoint: str | None = None,
    options: RunOptions = RunOptions(),
    on_outcomes: OnOutcomes | None = None,
    glob: str = DOCUMENT_GLOB,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """The same over a growing folder of files: those that are new since the last run, and those that are pending.

    The stream carries names alone; a table in ``checkpoint`` says which of them it has had, and the driver holds none. Bytes
    are hashed and, where a content is not settled yet, read in tasks; neither they nor page texts are shuffled or kept.
    ``read_pages`` turns one file's bytes into page texts. A file that is gone when its turn comes fails, and is not offered
    again. A file is new by its name, whatever its age.
    """
    place = checkpoint or f"{root}/stream"
    found = listed(spark, folder, glob)

    def files_of(batch: DataFrame) -> DataFrame:
        named = batch.select(F.lit(0).alias("argument"), "source_file", F.lit(None).cast("string").alias("error"))
        return in_arrival_order(fingerprinted(named))

    def stream() -> DataFrame:
        return _new_names(found, f"{place}/names", files_per_batch).select("source_file")

    arrivals = Arrivals(["source_file"], PENDING_NAMES, files_of, lambda batch: page_reader(read_pages))
    return _started(spark, stream, arrivals, root, rules, make_client, f"{place}/batches", options, on_outcomes)


def _new_names(found: DataFrame, place: str, files_per_batch: int | None) -> DataFrame:
    """A stream of the names in ``found`` (source_file, modified) that it has not had before, the oldest first.

    Spark's file source would hold every name of a folder on the driver, and plan a read of each. So the names that have been
    offered are a table at ``place``: new ones are added to it first, and the source sees its few files, each with many names.
    With ``files_per_batch`` a file has that many.
    """
    spark = found.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    with scratch_scope(spark):
        # Names take few bytes on disk, for which Spark would send all of them through the driver.
        offered = spark.read.schema(NAMES).parquet(place).select("source_file").hint("merge")
        new = settled(found.join(offered, "source_file", "left_anti"), "names")
        if not new.isEmpty():
            if files_per_batch:
                # One task writes file after file, so that their times are in this order.
                new = new.repartition(1).sortWithinPartitions("modified", "source_file")
            new.write.mode("append").option("maxRecordsPerFile", files_per_batch or 0).parquet(place)
    # What a run that died has left is offered whatever its age.
    reader = spark.readStream.schema(NAMES).option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", 1) if files_per_batch else reader).parquet(place)


def _started(
    spark: SparkSession,
    stream: Callable[[], DataFrame],
    arrivals: Arrivals,
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    checkpoint: str,
    options: RunOptions,
    on_outcomes: OnOutcomes | None,
) -> StreamingQuery:
    pending = PartLog(spark, f"{root}/pending", arrivals.schema)
    run = {"quota": False}

    def handle(batch: DataFrame, number: int) -> None:
        files = arrivals.files(batch)
        if run["quota"]:
            outcomes = settled(all_deferred(files), "outcomes")
        else:
            outcomes = run_files(spark, files, arrivals.pages(batch), root, rules, make_client, options)
            run["quota"] = bool(outcomes.where("outcome = 'deferred'").head(1)) or quota_failed(outcomes)
        gone = F.col("reason").startswith("FileNotFoundError") & F.col("source_hash").isNull()
        again = outcomes.where(F.col("outcome").isin("failed", "deferred") & ~F.coalesce(gone, F.lit(False)))
        again = again.select(*arrivals.key).distinct()
        left = again
        if arrivals.schema.names != arrivals.key:
            left = batch.select(*arrivals.schema.names).join(again, arrivals.key, "left_semi").dropDuplicates(arrivals.key)
        if number < 0:
            # This batch holds all that was pending, so what it leaves replaces the log.
            pending.compact(left)
        elif again.head(1):
            # A part per batch: what waits already is not written again.
            pending.add(f"batch-{number:012d}", left)
        if on_outcomes is not None:
            on_outcomes(outcomes, number)

    waiting = pending.read()
    if waiting.head(1):
        handle(waiting.dropDuplicates(arrivals.key), -1)
    return (
        stream().writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def quota_failed(outcomes: DataFrame) -> bool:
    """Whether a path of this batch hit the quota itself: the last one may leave nothing behind it to defer."""
    return bool(outcomes.where((F.col("outcome") == "failed") & (F.col("reason") == QUOTA_REASON)).head(1))


def all_deferred(files: DataFrame) -> DataFrame:
    """Outcomes of a batch that arrives after the quota is used up."""
    none = F.lit(None)
    return files.select(
        "seq",
        "source_file",
        "source_hash",
        F.lit("deferred").alias("outcome"),
        F.lit(DEFERRED_REASON).alias("reason"),
        none.cast("bigint").alias("record_id"),
        none.cast("string").alias("status"),
        none.cast("string").alias("part_number"),
        F.lit(0).alias("problem_count"),
    )
