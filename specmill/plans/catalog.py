"""The registered queries: each operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.operators import ledger as led
from specmill.operators import records as rec
from specmill.operators import upsert as up
from specmill.operators.journal import ReplyJournal
from specmill.operators.pieces import piece_table, searched
from specmill.operators.replies import RETRY_NOTE, parsed_reply_ok, prompt, resolved, with_raw
from specmill.operators.scoring import scored
from specmill.operators.selection import assembled, chosen_pages, keyword_score, with_excerpt
from specmill.operators.validation import as_records, of_severity
from specmill.plans import derivations as given
from specmill.plans.batch import RunOptions, run_texts
from specmill.plans.oracle import TEST_KEYWORDS, many_keywords
from specmill.session import scratch_path, settled
from specmill.sources.files import discover, exists, fingerprint, fingerprinted, state_of
from specmill.sources.pages import page_rows, paginate, without_text
from specmill.sources.rules import load_rules
from specmill.sources.tables import PartLog, exported, imported, ledger_table, record_table
from specmill.streaming.incremental import PENDING_NAMES, start_files, start_incremental

Query = Callable[[SparkSession, str], DataFrame]
RULES = load_rules()
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
TEST_SELECTION = {"keywords": TEST_KEYWORDS, "min_score": 4, "max_chars": 600}


class LengthModel:
    """A repeatable stand-in for a provider: what it says depends on the sheet's length."""

    def complete(self, prompt: str) -> str:
        again = prompt.endswith(RETRY_NOTE)
        chars = len(sheet_of(prompt))
        if chars % 10 == 0 or (chars % 5 == 0 and not again):
            return "no data"
        return f'{{"manufacturer": "maker", "part_number": "P{chars}"}}'


class QuotaModel(LengthModel):
    """Runs out of its quota at sheets of certain lengths."""

    def complete(self, prompt: str) -> str:
        if len(sheet_of(prompt)) % 400 == 7:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return super().complete(prompt)


class LaterModel(LengthModel):
    """Answers half of the sheets that got no answer at first."""

    def complete(self, prompt: str) -> str:
        chars = len(sheet_of(prompt))
        if chars % 20 == 0:
            return "no data"
        return f'{{"manufacturer": "maker", "part_number": "P{chars}"}}'


class PatientModel(LengthModel):
    """Answers every sheet at the second try at the latest."""

    def complete(self, prompt: str) -> str:
        chars = len(sheet_of(prompt))
        if chars % 5 == 0 and not prompt.endswith(RETRY_NOTE):
            return "no data"
        return f'{{"manufacturer": "maker", "part_number": "P{chars}"}}'


class PatientQuotaModel(PatientModel):
    """Runs out of its quota at the second try for sheets of certain lengths."""

    def complete(self, prompt: str) -> str:
        if len(sheet_of(prompt)) % 100 == 5 and prompt.endswith(RETRY_NOTE):
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return super().complete(prompt)


def sheet_of(prompt: str) -> str:
    return prompt.removesuffix(RETRY_NOTE).split('"""\n', 1)[1].removesuffix('\n"""')


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    documents = given.load(spark, folder, "documents").select("doc_id", "text")
    return paginate(documents)


_stored: dict[tuple, str] = {}


def _stored_once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from a folder, written once per application and state of the folder, and then only read."""
    key = (spark.sparkContext.applicationId, folder, name, state_of(spark, folder))
    if key not in _stored or not exists(spark, _stored[key]):
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The record table. Filters and column choices of the record queries end in its scan,
    and sorted listings do not repeat the extraction for their sampling pass."""
    return _stored_once(spark, folder, "records", lambda: given.records(spark, folder, RULES))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The file listing with hashes: texts are read and hashed once, ledger queries stay narrow."""
    return _stored_once(spark, folder, "listing", lambda: given.files(spark, folder))


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return rec.flattened(_records(spark, folder))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return given.checked(spark, folder, RULES)


# -- discovery and pages ---------------------------------------------------------


def q_fingerprint_dups(spark, folder):
    return led.first_copies(_files(spark, folder))


def q_paginate(spark, folder):
    return page_rows(_paged(spark, folder)).select(
        "doc_id", "page_no", F.length("text").alias("chars"), fingerprint(F.col("text")).alias("page_hash")
    )


def q_no_text(spark, folder):
    named = _paged(spark, folder).withColumn(
        "source_file", F.concat(F.lit("in/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    )
    return without_text(named).where("skip_reason IS NOT NULL").select("doc_id", "skip_reason")


def q_page_score(spark, folder):
    return page_rows(_paged(spark, folder)).select(
        "doc_id", "page_no", keyword_score(F.col("text"), TEST_KEYWORDS).alias("score")
    )


def _hashed(excerpts: DataFrame) -> DataFrame:
    return excerpts.select(
        "doc_id", F.length("excerpt").alias("chars"), fingerprint(F.col("excerpt")).alias("excerpt_hash")
    )


def q_page_score_many(spark, folder):
    return page_rows(_paged(spark, folder)).select(
        "doc_id", "page_no", keyword_score(F.col("text"), many_keywords()).alias("score")
    )


def q_page_select(spark, folder):
    return _hashed(with_excerpt(_paged(spark, folder), **TEST_SELECTION))


def q_page_select_long(spark, folder):
    documents = _paged(spark, folder)
    chosen = chosen_pages(page_rows(documents), "doc_id", **TEST_SELECTION)
    return _hashed(assembled(chosen, documents.select("doc_id"), "doc_id"))


def q_binary_discovery(spark, folder):
    # Every table's file, as documents of a folder; a table that is a folder of files is listed as one.
    found = fingerprinted(discover(spark, [folder, *[f"{folder}/{name}.parquet" for name in TABLES]], glob="*.parquet"))
    return found.select(
        "argument", F.element_at(F.split("source_file", "/"), -1).alias("file_name"), "length", "source_hash", "error"
    )


# -- prompts and replies -----------------------------------------------------------


def q_prompt_length(spark, folder):
    documents = given.load(spark, folder, "documents").select("doc_id", "text")
    first, again = prompt(F.col("text"), RULES), prompt(F.col("text"), RULES, retry=True)
    return documents.select(
        "doc_id", F.length(first).alias("chars"), fingerprint(first).alias("prompt_hash"),
        fingerprint(again).alias("retry_hash"),
    )


def q_first_valid_reply(spark, folder):
    return resolved(given.attempts(spark, folder), RULES).select(
        "source_hash", "attempt", "failure", "quota", F.col("raw.part_number").alias("part_number")
    )


def q_enforce_schema(spark, folder):
    raw = with_raw(given.replies(spark, folder), RULES)
    return raw.select(
        "seq", "raw.manufacturer", "raw.part_number", F.col("raw.weight.value").alias("weight_value"),
        F.col("raw.weight.unit").alias("weight_unit"), F.col("raw.operating_temp_min.value").alias("temp_value"),
        F.col("raw.operating_temp_min.unit").alias("temp_unit"),
        F.col("raw.response_time.value").alias("response_value"),
        F.when(F.col("raw.response_time.kind").isin("BOOLEAN", "STRING"), F.col("raw.response_time.kind")).alias("response_kind"),
    )


def q_quota_deferral(spark, folder):
    attempts = given.attempts(spark, folder)
    order = attempts.where("attempt = 1").select("source_hash", "seq")
    # Hashes are made here, so Spark's estimate of their size is far too low for a broadcast.
    results = resolved(attempts, RULES).select("source_hash", "failure", "quota").join(order.hint("merge"), "source_hash")
    # The cut-off and the outcomes both read the results; they are worked out once.
    results = settled(results, "results")
    cutoff = led.first_quota_seq(results)
    outcome = F.when(F.coalesce(F.col("seq") > cutoff, F.lit(False)), "deferred").when(
        F.col("failure").isNotNull(), "failed"
    )
    return results.select("seq", outcome.otherwise("stored").alias("outcome"))


def _unique_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Contents once each, with text, as (seq, source_hash, source_file, pages)."""
    documents = given.load(spark, folder, "documents").select("doc_id", "text")
    first = led.first_copies(_files(spark, folder)).select("seq", "source_hash", "source_file")
    return paginate(first.join(documents.withColumnRenamed("doc_id", "seq"), "seq"))


def q_score_job(spark, folder):
    readable = without_text(_unique_documents(spark, folder)).where("skip_reason IS NULL")
    attempts = scored(with_excerpt(readable), RULES, LengthModel)
    return attempts.select("source_hash", "attempt", parsed_reply_ok(F.col("reply"), RULES).alias("usable"))


def q_reply_journal(spark, folder):
    """Replies paid for by a run that ends for its quota and the run after it: as many as one healthy run needs."""
    readable = settled(with_excerpt(without_text(_unique_documents(spark, folder)).where("skip_reason IS NULL")), "readable")
    journal = ReplyJournal(spark, scratch_path(spark, "journal"))
    scored(readable, RULES, PatientQuotaModel, wave=512, in_flight=4, per_task=16, journal=journal)
    attempts = scored(readable, RULES, PatientModel, in_flight=4, journal=journal)
    used = attempts.groupBy("source_hash").agg(
        F.max(parsed_reply_ok(F.col("reply"), RULES)).alias("usable"), F.count("error").alias("errors")
    )
    paid = journal.read().where("error IS NULL").groupBy("source_hash").agg(
        F.count("*").alias("paid"), F.max("number").alias("last_number")
    )
    return paid.join(used, "source_hash")


# -- validation --------------------------------------------------------------------


def q_units(spark, folder):
    raw = with_raw(given.replies(spark, folder).select("seq", "reply"), RULES).drop("reply")
    units = raw.select(
        "seq", "raw",
        F.col("raw.operating_temp_min.unit").alias("temp_unit"), F.col("raw.weight.unit").alias("weight_unit"),
        F.col("raw.supply_voltage_min.unit").alias("volt_unit"),
    )
    return given.validated(units, RULES).select(
        "seq", "data.operating_temp_min", "temp_unit", "data.weight", "weight_unit", "data.supply_voltage_min", "volt_unit"
    )


def q_number_guard(spark, folder):
    own = F.filter("problems", lambda p: p["field"] == "response_time")
    return _checked(spark, folder).select("seq", "data.response_time", F.try_element_at(own, F.lit(1))["code"].alias("code"))


def q_enum_pattern(spark, folder):
    def count(code):
        return F.size(F.filter("problems", lambda p: p["code"] == code))

    return _checked(spark, folder).select(
        "seq", "data.sensor_type", "data.output_signal", "data.ip_rating",
        count("invalid_enum").alias("bad_enums"), count("pattern_mismatch").alias("bad_patterns"),
    )


def q_validate_problems(spark, folder):
    rows = _checked(spark, folder).select("seq", F.posexplode("problems").alias("position", "p"))
    return rows.select("seq", "position", "p.field", "p.code", "p.severity", "p.message")


def q_validated_values(spark, folder):
    return _checked(spark, folder).select("seq", "status", "data.*")


def q_status_counts(spark, folder):
    return _checked(spark, folder).groupBy("status").agg(F.count("*").alias("records"))


def q_on_file(spark, folder):
    return rec.on_file(_flat(spark, folder))


def q_severity_slices(spark, folder):
    rows = _checked(spark, folder)
    records = as_records(
        rows.withColumn("errors", F.lit(0)), RULES, extracted_at=F.lit("2024-01-01").cast("timestamp")
    )
    return records.select(
        "source_hash", "manufacturer", "part_number", "status",
        F.size(of_severity(F.col("problems"), "error")).alias("errors"),
        F.size(of_severity(F.col("problems"), "warning")).alias("warnings"),
    )


# -- ledger ------------------------------------------------------------------------


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of the run with the ledger's view and a simulated processing result."""
    files = _files(spark, folder)
    short = files.where("chars < 20").select("source_hash").distinct()
    known = led.with_history(led.first_copies(files), given.ledger(files))
    known = known.join(short.withColumn("short", F.lit(True)), "source_hash", "left")
    outcome = F.when(F.col("short"), "skipped").when(F.col("seq") % 5 == 0, "failed").otherwise("stored")
    stored = F.col("outcome") == "stored"
    return known.withColumn("outcome", F.when(F.col("todo"), outcome)).select(
        "source_hash", "seq", "source_file", "todo", "old_outcome", "old_id", "outcome",
        F.when(F.col("outcome") == "skipped", "too short").when(F.col("outcome") == "failed", "RuntimeError: down").alias("reason"),
        F.when(stored, F.col("seq") + 1000000).alias("record_id"),
        F.when(stored, "ok").alias("status"),
        F.when(stored, F.concat(F.lit("P-"), F.col("seq").cast("string"))).alias("part_number"),
        F.when(stored, (F.col("seq") % 3).cast("int")).alias("problem_count"),
    )


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    nothing_deferred = F.lit(None).cast("bigint")
    return led.path_outcomes(_files(spark, folder), _contents(spark, folder), nothing_deferred)


def q_unseen(spark, folder):
    files = _files(spark, folder)
    return led.unseen(files, given.ledger(files)).select("seq", "source_file", "source_hash")


def q_seen_filter(spark, folder):
    return _outcomes(spark, folder)


def q_ledger_merge(spark, folder):
    handled = _contents(spark, folder).where("todo").withColumn("processed_at", F.lit("2024-02-01").cast("timestamp"))
    merged = led.merged_ledger(given.ledger(_files(spark, folder)), handled)
    return led.ledger_listing(merged).select("source_hash", "source_file", "outcome", "reason", "record_id")


def q_run_summary(spark, folder):
    return led.run_summary(_outcomes(spark, folder))


def q_outcome_lines(spark, folder):
    return _outcomes(spark, folder).select("seq", led.outcome_line().alias("line"))


def q_run_quota(spark, folder):
    """A whole run whose model runs out of its quota on the way."""
    outcomes = run_texts(_arrivals(spark, folder), scratch_path(spark, "run"), RULES, QuotaModel, RunOptions(wave=128))
    return outcomes.select("seq", "outcome", "reason")


def q_run_resume(spark, folder):
    """The run after that one: what was stored or skipped is left alone, the rest is done; read back from both tables."""
    root = scratch_path(spark, "run")
    run_texts(_arrivals(spark, folder), root, RULES, QuotaModel, RunOptions(wave=128))
    again = run_texts(_arrivals(spark, folder), root, RULES, LengthModel)
    stored = record_table(spark, root, RULES).read().select(F.col("id").alias("record_id"), "part_number", "status")
    ledger = ledger_table(spark, root).read().select("source_hash", F.col("outcome").alias("in_ledger"), "record_id")
    known = ledger.join(stored, "record_id", "left")
    return again.select("seq", "source_hash", "outcome").join(known, "source_hash", "left").select(
        "seq", "outcome", "in_ledger", "part_number", F.col("status").alias("record_status")
    )


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as arriving files with their pages."""
    documents = given.load(spark, folder, "documents")
    return paginate(
        documents.select(
            F.col("doc_id").alias("seq"),
            F.concat(F.lit("in/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"),
            fingerprint(F.col("text")).alias("source_hash"), "text",
        )
    )


def q_stream_incremental(spark, folder):
    """Two runs over a stream of three micro-batches; the second has no new files, but what failed is tried again."""
    root, source = scratch_path(spark, "incremental"), scratch_path(spark, "arriving")
    arrivals = _arrivals(spark, folder).drop("seq")
    arrivals.repartition(3, "source_hash").write.parquet(source)
    for model in (LengthModel, LaterModel):
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_incremental(stream, root, RULES, model).awaitTermination()
    return ledger_table(spark, root).read().select(
        "source_hash", "outcome", F.col("record_id").isNotNull().alias("has_record")
    )


def q_stream_files(spark, folder):
    """A folder of files that grows in three steps, the last one with copies under new names; a run after each step."""
    root, arriving = scratch_path(spark, "files"), scratch_path(spark, "arriving")
    documents = given.load(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL")
    for step in range(3):
        given.put_files(documents.where(F.col("doc_id") % 3 == step), arriving, "doc")
        if step == 2:
            given.put_files(documents.where(F.col("doc_id") % 3 == 0), arriving, "copy")
        start_files(spark, arriving, lines_of, root, RULES, LengthModel).awaitTermination()
    ledger = ledger_table(spark, root).read()
    pending = PartLog(spark, f"{root}/pending", PENDING_NAMES).read().distinct()
    names = ledger.select(F.element_at(F.split("source_file", "/"), -1).alias("file"), "source_hash", "outcome", "record_id")
    waiting = pending.select(F.element_at(F.split("source_file", "/"), -1).alias("file"), F.lit(True).alias("_waits"))
    return names.join(waiting, "file", "left").select(
        "source_hash", "outcome", F.col("record_id").isNotNull().alias("has_record"), F.col("_waits").isNotNull().alias("waits")
    )


def lines_of(blob: bytes) -> list[str]:
    """A text file's lines as its pages."""
    return blob.decode().split("\n")


# -- upsert ------------------------------------------------------------------------


def q_upsert_fast(spark, folder):
    current = given.upsert_rows(spark, folder, 0, 2).withColumnRenamed("seq", "id").withColumn("id", F.col("id") + 1)
    table, _ = up.upserted(current, given.upsert_rows(spark, folder, 1))
    return table.select("id", "source_hash", "manufacturer", "part_number", "p_size")


def q_upsert_reidentify(spark, folder):
    table, _ = up.upserted(*given.reidentified(spark, folder))
    return table.select("id", "source_hash", "part_number", "p_size")


def q_record_get(spark, folder):
    return up.by_id(_records(spark, folder), 8).select("id", "manufacturer", "part_number", "status")


def q_record_count(spark, folder):
    return up.record_count(_records(spark, folder))


# -- record queries ------------------------------------------------------------------


def q_list_ordered(spark, folder):
    flat = rec.flattened(rec.listed(_records(spark, folder)))
    return flat.select("id", *rec.table_view(flat).columns)


def q_find(spark, folder):
    cold = rec.found(_records(spark, folder), "operating_temp_min", "<", -20)
    return cold.select("id", "manufacturer", "part_number", "data.operating_temp_min", "status")


def q_find_text(spark, folder):
    return rec.found(_records(spark, folder), "sensor_type", "!=", "temperature").select("id", "part_number", "data.sensor_type")


def q_facet_filter(spark, folder):
    rows = rec.filtered(
        _flat(spark, folder), manufacturers=["Brand#1", "Brand#2", "Brand#3", "Brand#17"],
        statuses=["warning", "error"], search=" RING ", cold_limit=-5, bounds=[("weight", ">", 100)],
    )
    return rows.select("id", "part_number", "manufacturer", "sensor_type", "status", "operating_temp_min")


def q_facet_search(spark, folder):
    flat = _flat(spark, folder)
    pieces = _stored_once(spark, folder, "query-pieces", lambda: piece_table(flat))
    rows = searched(flat, pieces, " RING ")
    rows = rec.filtered(rows, statuses=["warning", "error"], cold_limit=-5, bounds=[("weight", ">", 100)])
    return rows.select("id", "part_number", "manufacturer", "sensor_type", "status", "operating_temp_min")


def q_facet_values(spark, folder):
    return rec.facet_values(_flat(spark, folder), "manufacturer")


def q_flatten(spark, folder):
    first = F.try_element_at(
        F.from_json("problems_json", "array<struct<severity:string,field:string,message:string>>"), F.lit(1)
    )
    return _flat(spark, folder).select(
        "id", "status", "status_word", "problem_count", "source_file", first["severity"].alias("first_severity"),
        first["field"].alias("first_field"), first["message"].alias("first_message"),
    )


def q_json_export(spark, folder):
    back = imported(exported(_records(spark, folder), RULES), RULES)
    return back.select(
        "id", "data.manufacturer", "data.sensor_type", "data.weight", "data.operating_temp_min", "data.ip_rating",
        F.size("problems").alias("problem_count"), F.try_element_at("problems", F.lit(1))["code"].alias("first_code"),
    )


def q_span_report(spark, folder):
    return rec.spans(_flat(spark, folder))


def q_match_kpi(spark, folder):
    return rec.answer(_flat(spark, folder), manufacturers=["Brand#1", "Brand#5"], cold_limit=-20, search="bolt")


def q_problem_detail(spark, folder):
    return rec.details(_records(spark, folder))


def q_dashboard(spark, folder):
    form = {"status": "any", "manufacturer": "Brand#1", "sensor_type": None, "search": " in ", "cold_limit": -5}
    matched, said, shown = rec.dashboard(_flat(spark, folder), **form)
    none = F.lit(None)
    return (
        matched.select(F.lit("row").alias("part"), "id", F.col("part_number").alias("text"), none.cast("double").alias("span"))
        .unionByName(said.select(F.lit("answer").alias("part"), none.cast("bigint").alias("id"), "text", none.cast("double").alias("span")))
        .unionByName(shown.select(F.lit("span").alias("part"), "id", F.col("label").alias("text"), "span"))
    )


def q_page_of_results(spark, folder):
    return rec.page_of(_flat(spark, folder), 3, by="weight", descending=True).select("id", "part_number", "weight")


def all_queries() -> dict[str, Query]:
    """Every ``q_`` function of this module by its name."""
    return {name: run for name, run in globals().items() if name.startswith("q_")}
