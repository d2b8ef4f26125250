"""Joins and ids with one key holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from datatrawl.operators.ids import dense_ids, highest_id
from datatrawl.operators.joins import salted_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"),
        (F.col("id") % 5).alias("v"))
    right = spark.range(600).select(
        F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("w")).union(
        spark.createDataFrame([("hot", -1)], "key string, w long"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(sides, how):
    left, right = sides
    got, want = salted_join(left, right, "key", how), left.join(right, "key", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_ids_are_dense_unique_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    table = spark.createDataFrame([(7,), (41,)], "id int")
    once = {r.url: r.id for r in dense_ids(df, ["url"], highest_id(table)).collect()}
    again = {r.url: r.id for r in dense_ids(df.repartition(13), ["url"], highest_id(table)).collect()}
    assert sorted(once.values()) == list(range(42, 5042))
    assert once == again
    assert dense_ids(df.limit(1), ["url"], highest_id(table.limit(0))).first().id == 1
