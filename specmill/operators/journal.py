"""Replies that were paid for, kept as they come in and not asked for again.

Every task of a run adds its replies when it ends, whatever becomes of the run. The next run finds them by content
and prompt: a usable reply is taken as it is, and a document that had not used up its attempts goes on where it
stopped. What a finished run has settled is removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmill.operators.replies import parsed_reply_ok
from specmill.sources.rules import RuleSet
from specmill.sources.tables import PartLog

# ``number`` counts the replies to one prompt over all runs, ``attempt`` those of one round of a run.
REPLIES = "source_hash string, prompt_hash string, number int, seq bigint, attempt int, reply string, error string"


class ReplyJournal(PartLog):
    """The replies below ``root``, a folder per run and wave."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, f"{root.rstrip('/')}/replies", REPLIES)

    def new_run(self) -> str:
        """A fresh folder for the waves of one run."""
        return f"{self.root}/run-{uuid.uuid4().hex}"

    def replies(self) -> DataFrame:
        """All replies so far, each once; calls that ended in an error have none."""
        return self.read().where("error IS NULL").dropDuplicates(["source_hash", "prompt_hash", "number"])

    def prune(self, ledger: DataFrame) -> None:
        """Drop the replies of contents that ``ledger`` has as stored or skipped."""
        done = ledger.where(F.col("outcome") != "failed").select("source_hash")
        self.compact(self.replies().join(done, "source_hash", "left_anti"))


def recalled(prompts: DataFrame, journal: DataFrame, rules: RuleSet, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """What the journal has on ``prompts`` (source_hash, seq, prompt, prompt_hash).

    First the attempts (source_hash, seq, attempt, reply, error) that need no call. Then per document ``_done``, whether one of
    them is usable, ``_number``, how many replies its prompt has had, and ``_first``, the attempt to go on with. Replies of
    a round that used up its attempts are history: the document begins anew.
    """
    asked = prompts.select("source_hash", "seq", "prompt_hash")
    held = journal.select("source_hash", "prompt_hash", "number", "reply").join(asked, ["source_hash", "prompt_hash"])
    held = held.withColumn("_good", F.coalesce(parsed_reply_ok(F.col("reply"), rules), F.lit(False)))
    # As many rows per document as its prompt has had replies: a few.
    own = Window.partitionBy("source_hash")
    misses = F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(own)
    placed = held.withColumns(
        {
            "_done": F.max("_good").over(own),
            "_misses": misses,
            "_place": F.row_number().over(own.orderBy("_good", "number")),
            "_of": F.row_number().over(own.orderBy(F.col("_good").desc(), "number")),
        }
    )
    open_round = F.col("_place") - (F.col("_misses") - F.col("_misses") % max_attempts)
    usable = F.col("_good") & (F.col("_of") == 1)
    attempts = placed.where(F.when(F.col("_done"), usable).otherwise(open_round > 0)).select(
        "source_hash",
        "seq",
        F.when(usable, F.lit(1)).otherwise(open_round).cast("int").alias("attempt"),
        "reply",
        F.lit(None).cast("string").alias("error"),
    )
    states = placed.groupBy("source_hash").agg(
        F.max("_done").alias("_done"),
        F.max("number").alias("_number"),
        (F.max("_misses") % max_attempts + 1).cast("int").alias("_first"),
    )
    return attempts, states
