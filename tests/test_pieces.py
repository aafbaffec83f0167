"""Search through pieces against a look at every record."""

import random

import pytest
from pyspark.sql import functions as F

from specmill.operators.pieces import piece_table, searched
from specmill.operators.records import filtered

PARTS = ["NL-770/B", "nl-77", "NL", "", None, "ÄÖÜ-90", "straße 12", "aaaa", "İzmir-7", "a\u0000b c", "😀😀x😀", "NL-770/B"]


@pytest.fixture
def table(spark, tmp_path):
    rng = random.Random(8)
    parts = PARTS + ["".join(rng.choice("abAB-1") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "id bigint, part_number string")
    piece_table(rows).write.parquet(f"{tmp_path}/pieces")
    return rows, spark.read.parquet(f"{tmp_path}/pieces")


def test_equals_a_look_at_every_record(table):
    rows, pieces = table
    asked = ["nl-770", " NL-77 ", "nl", "b", "äöü", "STRASSE", "ße 1", "aaa", "aaaa", "aaaaa", "İZM", "izm", "😀x", "b c", "zzz", "ab-1", "-1a", "", "   "]
    for search in asked:
        expected = sorted(r.id for r in filtered(rows, search=search).collect())
        for few in (0, 1000):
            got = sorted(r.id for r in searched(rows, pieces, search, few=few).collect())
            assert got == expected, (search, few)


def test_pieces_are_counted_once_and_tables_may_be_empty(spark, table):
    rows, pieces = table
    assert pieces.count() == pieces.distinct().count()
    assert sorted(r.piece for r in pieces.where("id = 7").collect()) == ["aaa"]
    none = rows.where("false")
    assert searched(none, piece_table(none), "aaa").count() == 0
    nameless = rows.select(F.lit(None).cast("bigint").alias("id"), "part_number")
    assert piece_table(nameless).count() == 0


def test_a_search_reads_few_records(spark, tmp_path):
    # Numbers are dealt over the table, row groups are small, and few records hold the wanted one.
    rows = spark.range(60_000).select("id", F.concat(F.lit("P-"), F.hex("id"), F.lit("/"), F.col("id") % 7).alias("part_number"))
    small = {"parquet.block.size": "65536", "parquet.page.size": "8192"}
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.options(**small).parquet(f"{tmp_path}/records")
    records = spark.read.parquet(f"{tmp_path}/records")
    piece_table(records).write.parquet(f"{tmp_path}/pieces")
    found = searched(records, spark.read.parquet(f"{tmp_path}/pieces"), "beef")
    expected = sorted(r.id for r in filtered(records, search="beef").collect())
    assert sorted(r.id for r in found.collect()) == expected and expected == [0xBEEF]
    plan = found._jdf.queryExecution().executedPlan()
    assert "EqualTo(id,48879)" in plan.toString()
    # Row groups that cannot hold the id are not read.
    assert 0 < plan.collectLeaves().head().metrics().apply("numOutputRows").value() < 10_000
