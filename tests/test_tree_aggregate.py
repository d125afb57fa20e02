from collections import Counter

from pyspark.sql import functions as F

from guideloom.operators.tree_aggregate import count_of, heavy_keys, max_of, min_of, stacked_keys, sum_of, tree_aggregate, tree_rounds
from tests.conftest import rows


def test_rounds_are_logarithmic():
    assert [tree_rounds(n, 8) for n in (1, 8, 9, 64, 65, 10_000)] == [1, 1, 2, 2, 3, 5]


def test_hot_key_over_many_splits_equals_plain_aggregation(spark):
    data = [("hot" if i % 3 else f"k{i % 50}", i, None if i % 7 == 0 else i % 11) for i in range(5000)] + [(None, -1, 5), ("", 3, 3)]
    df = spark.createDataFrame(data, "k string, v long, n int").repartition(20).withColumn("count", F.lit("clash"))
    got = tree_aggregate(df, ["k"], [count_of("rows"), sum_of("s", F.col("v")), min_of("lo", F.col("n")), max_of("hi", F.col("n")), count_of("odd", F.col("v") % 2 == 1)], fan_in=2)
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.sum("v"), F.min("n"), F.max("n"), F.count_if(F.col("v") % 2 == 1))
    assert rows(got) == rows(want)


def test_intermediate_rounds_bound_the_states_of_a_key(spark):
    df = spark.range(1600, numPartitions=16).select(F.lit("hot").alias("k"))
    plan = tree_aggregate(df, ["k"], [count_of("n")], fan_in=4)._jdf.queryExecution().toString()
    assert plan.count("__node") > 0
    assert rows(tree_aggregate(df, ["k"], [count_of("n")], fan_in=4)) == [("hot", 1600)]


def test_heavy_keys_count_every_row(spark):
    data = [("a", "x")] * 50 + [("b", None)] * 49 + [(None, "y")] * 1 + [("a", "x" * 5000)]
    df = spark.createDataFrame(data, "query_name string, target_name string")
    n = len(data)
    want = [("query_name", k) for k, c in Counter(d[0] for d in data).items() if k and c * 50 >= n] + [("target_name", k) for k, c in Counter(d[1] for d in data).items() if k and c * 50 >= n]
    assert rows(heavy_keys(df, ["query_name", "target_name"])) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "query_name string, target_name string")
    assert rows(heavy_keys(df, ["query_name", "target_name"])) == []
    assert rows(tree_aggregate(stacked_keys(df, ["query_name"], []), ["key_field", "key_value"], [count_of("n")])) == []
