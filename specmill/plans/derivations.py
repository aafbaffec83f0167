"""Inputs of the registered queries, derived from the given tables.

Each derivation is one SQL text with two spellings for the few functions that Spark
and other engines name differently. All of them read whole tables row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.operators.replies import with_raw
from specmill.operators.validation import as_records, validated
from specmill.sources.files import put
from specmill.sources.rules import RuleSet

SPARK = {"sha": "sha2({0}, 256)", "four": "explode(array(1, 2, 3, 4))"}
ANSI = {"sha": "sha256({0})", "four": "unnest([1, 2, 3, 4])"}


# Parts whose replies one task makes and checks: some seconds of work from a few bytes each.
PARTS_PER_TASK = 20_000


def _value(value: str, unit: str) -> str:
    """SQL text building a JSON object with a value and a unit."""
    return f"""'{{"value": ' || {value} || ', "unit": ' || {unit} || '}}'"""


def _text(sql: str) -> str:
    return f"cast({sql} as string)"


def replies_sql(dialect: dict[str, str]) -> str:
    """(seq, source_file, source_hash, reply): one model reply per part.

    Values walk through units, spellings, bounds and defects along the part key.
    """
    k, s = "p_partkey", "p_size"
    odd = """case k % 16
      when 0 then '12' when 1 then '" 12 "' when 2 then '1e3' when 3 then '"1e999"'
      when 4 then '"nan"' when 5 then '"inf"' when 6 then '"about 120"' when 7 then '""'
      when 8 then '".5"' when 9 then '"1,5"' when 10 then '"0x10"' when 11 then 'true'
      when 12 then '"12d"' when 13 then '"1_000"' when 14 then 'null' else '"true"' end"""
    members = [
        """'"manufacturer": ' || case when k % 23 = 0 then 'null'
           when k % 9 = 0 then '"  ' || p_brand || ' "' else '"' || p_brand || '"' end""",
        f"""'"part_number": ' || case when k % 29 = 0 then '" "' when k % 11 = 5 then {_text('k')}
           else '"' || upper(p_name) || ' ' || {_text('k')} || '"' end""",
        """'"sensor_type": "' || case k % 10 when 0 then 'temperature' when 1 then 'Pressure'
           when 2 then 'PROXIMITY' when 3 then 'photoelectric' when 4 then ' flow ' when 5 then 'level'
           when 6 then 'Humidity' when 7 then 'vibration' when 8 then 'other' else p_type end || '"'""",
        "'\"supply_voltage_min\": ' || " + _value(
            f"case when k % 6 = 3 then {_text('(s % 30) * 1000')} else {_text('s % 30')} end",
            """case k % 6 when 0 then '"V"' when 1 then '"V DC"' when 2 then '"vdc"' when 3 then '"mV"'
               when 4 then '"V AC"' else 'null' end""",
        ),
        "'\"supply_voltage_max\": ' || " + _value(_text("s + 14"), "'\"V\"'"),
        """'"output_signal": ' || case k % 8 when 0 then '"4-20 mA"' when 1 then '"0-10 v"'
           when 2 then '"pnp"' when 3 then '"NPN"' when 4 then '"io-link"' when 5 then '"4...20 mA"'
           when 6 then '"relay"' else 'null' end""",
        "'\"operating_temp_min\": ' || " + _value(
            f"case when k % 4 = 2 then {_text('220 + s')} || '.15' else {_text('-s')} end",
            "case k % 4 when 0 then '\"C\"' when 1 then '\"° F\"' when 2 then '\"K\"' else 'null' end",
        ),
        "'\"operating_temp_max\": ' || " + _value(_text("s * 5"), "'\"ºC\"'"),
        f"""'"measuring_range": ' || case when k % 2 = 0 then '"0...' || {_text('s')} || ' bar"' else 'null' end""",
        """'"ip_rating": ' || case k % 5 when 0 then '"IP67"' when 1 then '"IP 65; IP67"'
           when 2 then '"IP6"' when 3 then '" IP69K "' else 'null' end""",
        "'\"response_time\": ' || " + _value(odd, "'\"ms\"'"),
        "'\"weight\": ' || case when k % 7 = 6 then " + _text("s") + " else " + _value(
            f"""case k % 7 when 3 then {_text('2 * s')} when 4 then {_text('s * 1000 + 250')}
                else {_text('s')} end""",
            """case k % 7 when 0 then '"g"' when 1 then '"kg"' when 2 then '"lbs"' when 3 then '"oz"'
               when 4 then '"MG"' else '"stone"' end""",
        ) + " end",
    ]
    body = " || ', ' || ".join(members)
    sha = dialect["sha"].format("'part-' || " + _text("k"))
    return f"""
      SELECT k AS seq, 'sheets/part-' || {_text('k')} || '.pdf' AS source_file, {sha} AS source_hash,
        case when k % 5 = 0 then '```json' || chr(10) || body || chr(10) || '```' else body end AS reply
      FROM (
        SELECT k, '{{' || {body} || case when k % 3 = 0 then ', "colour": "blue"' else '' end || '}}' AS body
        FROM (SELECT {k} AS k, {s} AS s, p_name, p_brand, p_type FROM part) keyed
      ) built"""


def attempts_sql(dialect: dict[str, str], quota_every: int = 611) -> str:
    """(seq, source_hash, attempt, reply, error): four attempts per part, the first ones broken."""
    return f"""
      SELECT seq, source_hash, attempt,
        case when error is not null then null
             when attempt > seq % 4 then reply
             when attempt = 1 then substr(reply, 1, 25)
             when attempt = 2 then '[1, 2, 3]'
             else 'Sorry, no data.' end AS reply,
        error
      FROM (
        SELECT seq, source_hash, attempt, reply,
          case when seq > 0 and seq % {quota_every} = 0 and attempt = 1
               then 'RuntimeError: 429 RESOURCE_EXHAUSTED: quota'
               when seq % 41 = 7 and attempt = 2 then 'TimeoutError: read timed out' end AS error
        FROM (SELECT seq, source_hash, reply, {dialect['four']} AS attempt FROM ({replies_sql(dialect)}) r) t
      ) e"""


def files_sql(dialect: dict[str, str]) -> str:
    """(seq, source_file, source_hash): documents seen as files; equal texts are equal contents."""
    sha = dialect["sha"].format("text")
    return f"SELECT doc_id AS seq, 'in/doc-' || {_text('doc_id')} || '.pdf' AS source_file, {sha} AS source_hash FROM documents"


def ledger_sql(dialect: dict[str, str]) -> str:
    """An earlier run's ledger: three quarters of the contents, by their first document."""
    return f"""
      SELECT source_hash, 'old/doc-' || {_text('m')} || '.pdf' AS source_file,
        case m % 4 when 0 then 'stored' when 1 then 'skipped' else 'failed' end AS outcome,
        case m % 4 when 1 then 'no text' when 2 then 'RuntimeError: down' end AS reason,
        case when m % 4 = 0 then m end AS record_id,
        timestamp '2024-01-01 00:00:00' AS processed_at
      FROM (SELECT source_hash, min(seq) AS m FROM ({files_sql(dialect)}) f GROUP BY source_hash) c
      WHERE m % 4 < 3"""


def upsert_rows_sql(*classes: int) -> str:
    """(seq, source_hash, manufacturer, part_number, p_size) from the parts of some key classes.

    Classes 0 and 2 play the stored table, class 1 the batch: half of the batch revises a stored
    part, a quarter of it is one hot part, some rows have no part number or maker.
    """
    return f"""
      SELECT seq, source_hash, p_size,
        case when hot then 'maker-hot' when seq % 7 = 3 then null else 'maker-' || {_text('g % 25')} end AS manufacturer,
        case when seq % 10 = 7 then null when hot then 'PN-HOT' else 'PN-' || {_text('g')} end AS part_number
      FROM (
        SELECT p_partkey AS seq, p_size, 'h' || {_text('p_partkey')} AS source_hash,
          (p_partkey % 4 = 1 and p_partkey % 3 = 1) AS hot,
          case when p_partkey % 3 = 1 and p_partkey % 2 = 0 then p_partkey - 1 else p_partkey end AS g
        FROM part WHERE p_partkey % 3 IN ({", ".join(map(str, classes))})
      ) keyed"""


def reidentified_old_sql() -> str:
    """(id, source_hash, manufacturer, part_number, p_size): the table before re-identification."""
    return f"""
      SELECT p_partkey + 1 AS id, 'h' || {_text('p_partkey')} AS source_hash, 'maker' AS manufacturer,
        'PN-' || {_text('p_partkey')} AS part_number, p_size
      FROM part WHERE p_partkey % 3 IN (0, 2)"""


def reidentified_batch_sql() -> str:
    """Batch rows that carry records from one identity to another.

    Per stored key k that is even: its file comes with a new part number, a fresh file
    takes the old one; where 4 divides k the fresh file moves along and both records share
    an identity. All keys of class 1 share the part HOT; the first of them moves away again.
    """
    def rows(step: int, digest: str, number: str, where: str) -> str:
        return f"""
          SELECT p_partkey * 10 + {step} AS seq, '{digest}' || {_text('p_partkey')} AS source_hash,
            'maker' AS manufacturer, {number} AS part_number, p_size FROM part WHERE {where}"""

    moved, old = f"'RE-' || {_text('p_partkey')}", f"'PN-' || {_text('p_partkey')}"
    even, fourth = "p_partkey % 6 = 0", "p_partkey % 12 = 0"
    return " UNION ALL ".join(
        [
            rows(1, "h", moved, even), rows(2, "f", old, even), rows(3, "f", moved, fourth),
            rows(4, "g", moved, fourth), rows(5, "f", moved, fourth),
            rows(6, "x", "'HOT'", "p_partkey % 3 = 1"), rows(7, "x", "'COLD'", "p_partkey = 1"),
        ]
    )


# -- the same inputs as DataFrames -------------------------------------------------


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in turn over so many partitions that each has ``PARTS_PER_TASK`` at most, and every core its share.

    Spark cuts a scan by bytes: of a table that makes much work from few bytes, a few tasks would get all.
    """
    tasks = -(-rows.count() // PARTS_PER_TASK)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism))


def derived(spark: SparkSession, folder: str, sql: str, table: str, deal: bool = False) -> DataFrame:
    """Run a derivation over one given table without leaving a view behind."""
    braced = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {given}")
    given = load(spark, folder, table)
    return spark.sql(braced, given=dealt(given) if deal else given)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, replies_sql(SPARK), "part", deal=True)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, attempts_sql(SPARK), "part", deal=True)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The file listing plus ``chars``, the length of the text behind a file."""
    sized = files_sql(SPARK).replace(" FROM documents", ", length(text) AS chars FROM documents")
    return derived(spark, folder, sized, "documents")


def ledger(listing: DataFrame) -> DataFrame:
    """The earlier run's ledger for a listing of :func:`files`."""
    sql = ledger_sql(SPARK).replace(f"({files_sql(SPARK)})", "{given}")
    return listing.sparkSession.sql(sql, given=listing)


def upsert_rows(spark: SparkSession, folder: str, *classes: int) -> DataFrame:
    stamped = derived(spark, folder, upsert_rows_sql(*classes), "part")
    return stamped.withColumn("extracted_at", F.lit("2024-01-01").cast("timestamp"))


def reidentified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    stamp = F.lit("2024-01-01").cast("timestamp")
    old = derived(spark, folder, reidentified_old_sql(), "part")
    new = derived(spark, folder, reidentified_batch_sql(), "part")
    return old.withColumn("extracted_at", stamp), new.withColumn("extracted_at", stamp)


def checked(spark: SparkSession, folder: str, rules: RuleSet) -> DataFrame:
    """Validated replies with ``seq`` and provenance."""
    return validated(with_raw(replies(spark, folder), rules).drop("reply"), rules)


def records(spark: SparkSession, folder: str, rules: RuleSet) -> DataFrame:
    """A record table: one record per part, ids from 1, a date along the part key."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("seq") % 365).cast("int")).cast("timestamp")
    rows = as_records(checked(spark, folder, rules), rules, extracted_at=day)
    return rows.withColumn("id", F.col("seq") + 1).drop("seq")


def put_files(documents: DataFrame, folder: str, stem: str) -> None:
    """Each document (doc_id, text) as a file ``<stem>-<doc_id>.pdf`` of its text in ``folder``."""

    def write(batches):
        for batch in batches:
            for number, text in zip(batch["doc_id"], batch["text"]):
                put(folder, f"{stem}-{number:012d}.pdf", text.encode())
            yield batch[["doc_id"]]

    spread = documents.repartition(documents.sparkSession.sparkContext.defaultParallelism, "doc_id")
    spread.mapInPandas(write, "doc_id bigint").write.format("noop").mode("overwrite").save()
