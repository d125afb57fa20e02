import math
import random

import pytest
from pyspark.sql import functions as F

from guideloom.llm.topn import top_n_per_group
from tests.conftest import rows


def brute(data, n):
    best = {}
    for group, item, score, ident in data:
        if group is None or score is None or math.isnan(score):
            continue
        best[(group, item)] = min(best.get((group, item), (math.inf, 0)), (-score, ident))
    out, by = [], {}
    for (group, item), (score, ident) in best.items():
        by.setdefault(group, []).append((score, item is not None, (item or "").encode(), item, ident))
    for group, items in by.items():
        out += [(group, x[3], x[4], k) for k, x in enumerate(sorted(items, key=lambda x: x[:3])[:n], 1)]
    return sorted(out, key=str)


def check(spark, data, n):
    df = spark.createDataFrame(data, "g string, item string, score double, id long").withColumn("pos", F.lit("clash")).withColumn("edge", F.lit(1))
    assert rows(top_n_per_group(df, "g", "item", "score", "id", n)) == brute(data, n)


@pytest.mark.parametrize("n", [1, 5, 700])
def test_hot_group_with_ties_over_all_partitions(spark, n):
    rng = random.Random(n)
    data = [("hot" if i % 3 else f"g{rng.randrange(200)}", f"t{rng.randrange(900)}", float(rng.randrange(4)), i) for i in range(4000)]
    check(spark, data, n)


def test_one_item_repeated_over_partitions(spark):
    check(spark, [("hot", "same", 1.0, i) for i in range(2000)] + [("hot", "other", 1.0, 5000), ("hot", "third", 0.5, 5001)], 3)


def test_nulls_nan_and_byte_order(spark):
    check(spark, [("a", None, 1.0, 1), ("a", "", 1.0, 2), ("a", "Z", 1.0, 3), ("a", "é", 1.0, 4), ("a", "a", 1.0, 5), ("a", "x", None, 6), ("a", "y", math.nan, 7), (None, "x", 1.0, 8), ("", "x", -1.0, 9), ("b", "x" * 10_000, 2.0, 10), ("a", "Z", 1.0, 3)], 4)


def test_empty_and_parameters(spark):
    check(spark, [], 2)
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([], "g string, item string, score double, id long"), "g", "item", "score", "id", 0)
