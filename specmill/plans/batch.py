"""One run over a set of files: from discovered paths to records, ledger and outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.operators.journal import ReplyJournal
from specmill.operators.ledger import first_copies, first_quota_seq, merged_ledger, path_outcomes, with_history
from specmill.operators.replies import MAX_ATTEMPTS, TextModel, resolved
from specmill.operators.scoring import PER_TASK, WAVE, scored
from specmill.operators.selection import MAX_CHARS, with_excerpt
from specmill.operators.upsert import upserted
from specmill.operators.validation import as_records, validated
from specmill.session import scratch_scope, settled
from specmill.sources.files import discover, fingerprinted, in_arrival_order, read_in_tasks
from specmill.sources.pages import MIN_CHARS, without_text
from specmill.sources.rules import RuleSet, check_units
from specmill.sources.tables import ledger_table, record_table

# Contents to process in, (source_hash, source_file, pages, error) out, at most one row per content.
PageLoader = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunOptions:
    """Settings of a run."""

    force: bool = False
    max_chars: int = MAX_CHARS
    min_chars: int = MIN_CHARS
    max_attempts: int = MAX_ATTEMPTS
    wave: int = WAVE
    tasks: int | None = None
    in_flight: int = 1
    per_task: int = PER_TASK


def run_files(
    spark: SparkSession,
    files: DataFrame,
    load_pages: PageLoader,
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    options: RunOptions = RunOptions(),
) -> DataFrame:
    """Process ``files`` (seq, source_file, source_hash, error) against the tables below ``root``.

    Returns one outcome row per path; what the run wrote in between is removed at its end. Records are written before the ledger: a run that
    dies in between processes those files again and updates the same records.
    Files with an ``error`` and no hash fail without a ledger entry. Replies that were paid for are kept until their files
    are settled: neither a quota error nor a run that dies makes a later one pay for them again.
    """
    with scratch_scope(spark):
        return _run_files(spark, files, load_pages, root, rules, make_client, options)


def _run_files(
    spark: SparkSession,
    files: DataFrame,
    load_pages: PageLoader,
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    options: RunOptions,
) -> DataFrame:
    check_units(rules)
    records, ledger = record_table(spark, root, rules), ledger_table(spark, root)
    old_ledger = ledger.read()
    readable = files.where(F.col("source_hash").isNotNull())
    # Written first: the size of a written table is known, so a short one is broadcast to the ledger's scan.
    copies = settled(first_copies(readable), "copies")
    contents = settled(with_history(copies, old_ledger, options.force), "contents")
    todo = contents.where("todo").select("source_hash", "seq", "source_file")

    # Pages become a skip reason and an excerpt where they are read: only these go through the join.
    loaded = without_text(load_pages(todo), options.min_chars)
    narrow = with_excerpt(loaded, max_chars=options.max_chars).select(
        "source_hash", "skip_reason", "error", "excerpt"
    )
    found = todo.select("source_hash", "seq").join(narrow.withColumn("_found", F.lit(True)), "source_hash", "left")
    gone = F.when(F.col("_found").isNull(), "FileNotFoundError: content is no longer there")
    documents = settled(found.withColumn("error", F.coalesce("error", gone)).drop("_found"), "documents")
    to_score = documents.where("skip_reason IS NULL AND error IS NULL")
    # A forced run asks again; it still leaves its replies to the next run, should it die.
    journal = ReplyJournal(spark, root)
    attempts = scored(
        to_score, rules, make_client, options.max_attempts, options.wave, tasks=options.tasks,
        in_flight=options.in_flight, per_task=options.per_task, journal=journal, recall=not options.force,
    )

    answers = settled(resolved(attempts, rules, options.max_attempts), "answers")
    judged = documents.join(answers, "source_hash", "left")
    # The first quota error ends the run for every later path.
    cutoff: Column = first_quota_seq(judged)
    in_time = judged.where(F.coalesce(F.col("seq") <= cutoff, F.lit(True)))
    failure = F.coalesce("error", "failure")
    handled = in_time.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("skip_reason").isNotNull(), "skipped")
        .when(F.col("raw").isNotNull(), "stored")
        .when(F.col("failure").isNotNull(), "failed"),
    ).where(F.col("outcome").isNotNull())
    handled = handled.select(
        "source_hash", "outcome", F.coalesce(failure, "skip_reason").alias("reason"), "raw"
    )

    # A forced run handles every copy; the first and the last one decide what remains.
    last_file = F.col("last_file") if options.force else F.col("source_file")
    extracted = handled.where("outcome = 'stored'").join(
        contents.select("source_hash", "seq", "source_file", "last_seq", last_file.alias("last_file")),
        "source_hash",
    )
    checked = validated(extracted, rules)
    batch = as_records(checked, rules)
    if options.force:
        again = checked.where("last_seq > seq").withColumns(
            {"seq": F.col("last_seq"), "source_file": F.col("last_file")}
        )
        batch = batch.unionByName(as_records(again, rules))
    batch = settled(batch, "batch")
    table, placed = upserted(records.read(), batch)
    placed = settled(
        batch.select("seq", "source_hash", "status", "part_number", F.size("problems").alias("problem_count"))
        .join(placed, "seq")
        .groupBy("source_hash")
        .agg(F.max_by(F.struct("record_id", "status", "part_number", "problem_count"), "seq").alias("p"))
        .select("source_hash", "p.*"),
        "placed",
    )
    records.replace(table, sort=["manufacturer", "part_number"])

    results = settled(
        handled.select("source_hash", "outcome", "reason").join(placed, "source_hash", "left"), "results"
    )
    entries = (
        results.join(contents.select("source_hash", "source_file", "last_file"), "source_hash")
        .withColumn("source_file", last_file)
        .withColumn("processed_at", F.current_timestamp())
    )
    ledger.replace(merged_ledger(old_ledger, entries), sort=["source_hash"])
    journal.prune(ledger.read())

    seen = contents.join(results, "source_hash", "left")
    outcomes = path_outcomes(readable, seen, cutoff, options.force)
    lost = files.where(F.col("source_hash").isNull()).select(
        "seq", "source_file", "source_hash",
        F.when(F.col("seq") > cutoff, "deferred").otherwise("failed").alias("outcome"),
        F.col("error").alias("reason"),
        F.lit(None).cast("bigint").alias("record_id"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("part_number"),
        F.lit(0).alias("problem_count"),
    )
    outcomes = settled(outcomes.unionByName(lost), "outcomes", lasting=True)
    open_ended = outcomes.where("outcome IS NULL").select("source_file").head(3)
    if open_ended:
        raise RuntimeError(f"paths without an outcome, such as {[r.source_file for r in open_ended]}")
    return outcomes


def run_paths(
    spark: SparkSession,
    paths: list[str],
    read_pages: Callable[[bytes], list[str]],
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    options: RunOptions = RunOptions(),
) -> DataFrame:
    """Process files and folders on disk; ``read_pages`` turns one file's bytes into page texts.

    Files are read once for their hashes and a second time, by name, if they are not settled yet. Their bytes
    stay in the task that reads them.
    """
    files = in_arrival_order(fingerprinted(discover(spark, paths)))
    return run_files(spark, files, page_reader(read_pages), root, rules, make_client, options)


def page_reader(read_pages: Callable[[bytes], list[str]]) -> PageLoader:
    """Reads the files to process by name, each in one task."""

    def load_pages(todo: DataFrame) -> DataFrame:
        wanted = todo.select("source_hash", "source_file", F.lit(None).cast("string").alias("error"))

        def pages_of(stream) -> list[str]:
            return [(page or "").strip() for page in read_pages(stream.read())]

        return read_in_tasks(wanted, pages_of, "pages", T.ArrayType(T.StringType()))

    return load_pages


def run_texts(
    documents: DataFrame,
    root: str,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    options: RunOptions = RunOptions(),
) -> DataFrame:
    """Process a table (seq, source_file, source_hash, pages) whose pages are already text."""
    spark = documents.sparkSession

    def load_pages(todo: DataFrame) -> DataFrame:
        # Joined on the first copy's arrival number, so each content arrives once.
        return documents.join(todo.select("seq"), "seq", "left_semi").select(
            "source_hash", "source_file", "pages", F.lit(None).cast("string").alias("error")
        )

    with scratch_scope(spark):
        # A run looks at its files several times; texts are cut and hashed once for all of them.
        files = settled(
            documents.select("seq", "source_file", "source_hash", F.lit(None).cast("string").alias("error")), "files"
        )
        return run_files(spark, files, load_pages, root, rules, make_client, options)
