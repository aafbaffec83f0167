"""Model calls as a Spark job: prompts in, an attempts table out.

Calls cost money and do not repeat exactly, so their results are written out before
anything reads them: every task adds its replies when it ends, and a run that dies leaves them to the next one. Documents go
to the model in waves along the arrival order, a run of neighbours per task, some calls at a time. The first
quota error leaves a mark in the shared folder. From then on no task calls for a document behind it; documents before it are still
asked, as they would have been one by one. After the wave the rest is left alone and later reported as deferred.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.operators.journal import REPLIES, ReplyJournal, recalled
from specmill.operators.replies import MAX_ATTEMPTS, RETRY_NOTE, TextModel, is_quota_error, parsed_object, prompt
from specmill.session import scratch_path, settled
from specmill.sources.files import names_in, put
from specmill.sources.rules import RuleSet

ATTEMPTS = "source_hash string, seq bigint, attempt int, reply string, error string"
WAVE = 1 << 20
# Documents of one task: what an executor that is lost has to ask again, at most.
PER_TASK = 256
COLUMNS = ["source_hash", "prompt_hash", "number", "seq", "attempt", "reply", "error"]


class QuotaMarks:
    """Where the quota has ended: a file per arrival number, in a folder that all tasks see."""

    def __init__(self, folder: str):
        self.folder = folder

    def note(self, seq: int) -> None:
        put(self.folder, f"{seq:020d}")

    def ended_before(self, seq: int) -> bool:
        found = names_in(self.folder)
        return bool(found) and int(min(found)) < seq


def _asked(document, client: TextModel, marks: QuotaMarks, max_attempts: int) -> list[tuple]:
    """All calls for one document, as rows of the journal."""
    digest, prompt_hash, seq, first, attempt, number = document
    rows = []
    while attempt <= max_attempts:
        if marks.ended_before(seq):
            break
        number += 1
        reply, note = None, None
        try:
            reply = client.complete(first if attempt == 1 else first + RETRY_NOTE)
        except Exception as problem:  # noqa: BLE001 - a failed call is a row
            note = f"{type(problem).__name__}: {problem}"
            if getattr(problem, "code", None) == 429 and "429" not in note:
                note = f"{note} (429)"
            if "429" in note or "RESOURCE_EXHAUSTED" in note:
                marks.note(seq)
        rows.append((digest, prompt_hash, number, seq, attempt, reply, note))
        if note is not None or parsed_object(reply) is not None:
            break
        attempt += 1
    return rows


def _caller(make_client: Callable[[], TextModel], max_attempts: int, in_flight: int, folder: str):
    def run(batches):
        marks, own = QuotaMarks(folder), threading.local()

        def ask(document):
            if not hasattr(own, "client"):
                own.client = make_client()
            return _asked(document, own.client, marks, max_attempts)

        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()
            for batch in batches:
                found = []
                fields = ("source_hash", "prompt_hash", "seq", "prompt", "_first", "_number")
                for document in zip(*(batch[c].tolist() for c in fields)):
                    waiting.append(pool.submit(ask, document))
                    # The oldest call is waited for: rows leave in arrival order, and at most in_flight are open.
                    if len(waiting) >= in_flight:
                        found += waiting.popleft().result()
                yield pd.DataFrame(found, columns=COLUMNS)
            found = [row for call in waiting for row in call.result()]
            yield pd.DataFrame(found, columns=COLUMNS)

    return run


def scored(
    documents: DataFrame,
    rules: RuleSet,
    make_client: Callable[[], TextModel],
    max_attempts: int = MAX_ATTEMPTS,
    wave: int = WAVE,
    text: str = "excerpt",
    tasks: int | None = None,
    in_flight: int = 1,
    per_task: int = PER_TASK,
    journal: ReplyJournal | None = None,
    recall: bool = True,
) -> DataFrame:
    """Attempts for ``documents`` (source_hash, seq, excerpt), one row per call.

    ``make_client`` is called in the executor, once per task and call that may be open at a time: ``in_flight`` of them.
    ``tasks`` is how many run at a time at least, the session's default parallelism if not given; a task has ``per_task`` documents at
    most. ``seq`` should be dense: it is cut into waves of ``wave`` numbers. Only the ends of its range and one flag per wave
    reach the driver.

    With a ``journal`` replies are kept there, and with ``recall`` those it has are not paid for again.

    Every task starts its documents in arrival order, and stops for a quota error of an earlier one only. What is
    left out therefore lies behind the first quota error of all.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    if in_flight < 1 or per_task < 1:
        raise ValueError("in_flight and per_task must be at least 1")
    spark = documents.sparkSession
    path = journal.new_run() if journal else scratch_path(spark, "attempts")
    # Written in ranges of seq, so that a wave reads the files of its own range only.
    documents = documents.select("source_hash", F.col("seq").cast("bigint").alias("seq"), F.col(text).alias("excerpt"))
    documents = settled(documents.repartitionByRange("seq").sortWithinPartitions("seq"), "to-score")
    prompts = documents.select("source_hash", "seq", prompt(F.col("excerpt"), rules).alias("prompt"))
    prompts = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    low, high = documents.agg(F.min("seq"), F.max("seq")).first()
    known = spark.createDataFrame([], ATTEMPTS)
    if low is None:
        return known
    fresh = {"_first": F.lit(1), "_number": F.lit(0)}
    if journal and recall and journal.read().head(1):
        known, states = recalled(prompts, journal.replies(), rules, max_attempts)
        known, states = settled(known, "recalled"), settled(states, "recalled-states")
        prompts = prompts.join(states, "source_hash", "left").where(~F.coalesce("_done", F.lit(False)))
        fresh = {"_first": F.coalesce("_first", F.lit(1)), "_number": F.coalesce("_number", F.lit(0))}
    prompts = prompts.withColumns(fresh)
    call = _caller(make_client, max_attempts, in_flight, scratch_path(spark, "quota"))
    replies = spark.read.schema(REPLIES)
    start, number = low, 0
    while start is not None and start <= high:
        span = min(wave, high - start + 1)
        count = max(tasks or spark.sparkContext.defaultParallelism, -(-span // per_task))
        here = prompts.where((F.col("seq") >= start) & (F.col("seq") < start + wave))
        # Neighbours in arrival order go to one task; a wave's tasks begin in that order too.
        place = F.floor((F.col("seq") - start) * count / F.lit(span)).cast("int")
        here = here.repartitionById(count, place).sortWithinPartitions("seq")
        part = f"{path}/wave={number}"
        # A task's replies are in place as soon as it ends, not only when all have ended.
        writer = here.mapInPandas(call, REPLIES).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(part)
        if not replies.parquet(part).where(is_quota_error(F.col("error"))).isEmpty():
            break
        # Sparse numbering: jump to the next document that exists.
        start = documents.where(F.col("seq") >= start + wave).agg(F.min("seq")).first()[0]
        number += 1
    # A task that was run twice may have left its first replies too.
    new = replies.option("recursiveFileLookup", "true").parquet(path).dropDuplicates(["source_hash", "attempt"])
    return new.select("source_hash", "seq", "attempt", "reply", "error").unionByName(known)
