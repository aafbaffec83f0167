"""What decides whether large inputs fit: joins that go through the driver, tasks that get all rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from specmill.operators.replies import resolved
from specmill.plans import batch, catalog
from specmill.plans import derivations as given
from specmill.sources.files import in_arrival_order, names_in, put
from specmill.sources.pages import paginate


@pytest.fixture
def folder(tmp_path):
    """A table folder with 40 parts in one file."""
    n = 40
    parts = {
        "p_partkey": pa.array(range(n), pa.int64()), "p_name": [f"part {i}" for i in range(n)],
        "p_brand": [f"Brand#{i % 5}" for i in range(n)], "p_type": ["STEEL"] * n,
        "p_size": pa.array([i % 50 + 1 for i in range(n)], pa.int32()),
    }
    pq.write_table(pa.table(parts), tmp_path / "part.parquet")
    return str(tmp_path)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_replies_do_not_go_through_the_driver(spark, rules, folder):
    # Made texts of any length look like 20 bytes to Spark, so these would be broadcast at any size.
    attempts = given.attempts(spark, folder).withColumn("reply", F.repeat("reply", 1000))
    assert "Broadcast" not in plan(resolved(attempts, rules))


def test_arrival_numbers_do_not_go_through_the_driver(spark, folder, monkeypatch):
    plans = []
    kept = catalog.settled
    monkeypatch.setattr(catalog, "settled", lambda rows, name: plans.append(plan(rows)) or kept(rows, name))
    found = catalog.q_quota_deferral(spark, folder)
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    assert found.count() == 40


def test_parts_of_one_file_are_dealt_over_tasks(spark, folder, monkeypatch):
    for made in (given.replies, given.attempts):
        assert made(spark, folder).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(given, "PARTS_PER_TASK", 6)
    sizes = given.replies(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) <= 7
    assert given.replies(spark, folder).count() == 40


def test_a_run_over_texts_cuts_and_hashes_them_once(spark, rules, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(i, f"{i}.pdf", f"text {i}") for i in range(5)], "seq bigint, source_file string, text string")
    documents = paginate(texts.withColumn("source_hash", F.sha2("text", 256)))

    def looked_at(spark, files, *_):
        seen = plan(files)
        return ("Generate" in seen or "sha2" in seen), sorted(r["seq"] for r in files.collect())

    monkeypatch.setattr(batch, "run_files", looked_at)
    assert batch.run_texts(documents, str(tmp_path), rules, None) == (False, [0, 1, 2, 3, 4])


def test_files_are_read_once_to_be_put_in_order(spark, tmp_path):
    folder = str(tmp_path / "read")

    def read(batches):
        for rows in batches:
            for name in rows["source_file"]:
                put(folder, f"{name}-{len(names_in(folder))}")
            yield rows

    files = spark.createDataFrame([(0, f"f{i}") for i in range(6)], "argument int, source_file string").repartition(2)
    ordered = in_arrival_order(files.mapInPandas(read, files.schema))
    assert [(r["source_file"], r["seq"]) for r in ordered.orderBy("seq").collect()] == [(f"f{i}", i) for i in range(6)]
    assert len(names_in(folder)) == 6
