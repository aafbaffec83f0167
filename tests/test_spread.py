"""The spread join: by lanes where the right side is large, by Spark's broadcast where it is small, with the same rows."""

import pytest
from pyspark.sql import functions as F

from specmill.functions.spread import is_small, spread_left_join


@pytest.fixture
def sides(spark, tmp_path):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    names = spark.range(40).select(F.concat(F.lit("k"), "id").alias("k"), "id").withColumnRenamed("id", "v").union(spark.sql("SELECT 'hot', 99L"))
    names.write.parquet(f"{tmp_path}/names")
    return rows, spark.read.parquet(f"{tmp_path}/names")


def joined(sides):
    out = spread_left_join(*sides, "k", F.col("id"))
    return out, out._jdf.queryExecution().executedPlan().toString()


def test_both_ways_give_the_same_rows(spark, sides):
    out, plan = joined(sides)
    assert is_small(sides[1]) and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    expected = sorted(map(repr, out.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, plan = joined(sides)
        assert not is_small(sides[1]) and "_lane" in plan and "Broadcast" not in plan
        assert out.columns == ["k", "id", "v"] and sorted(map(repr, out.collect())) == expected and len(expected) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = sides[0].join(sides[1], "k", "left")
    assert sorted(map(repr, plain.collect())) == expected
