import random

from pyspark.sql import functions as F

from guideloom.operators.intervals import spans_and_gaps
from tests.conftest import rows


def brute(data):
    by = {}
    for ent, lo, hi in data:
        if lo is not None and hi is not None and lo <= hi:
            by.setdefault(ent, []).append((lo, hi))
    out = []
    for ent, parts in by.items():
        spans = []
        for lo, hi in sorted(parts):
            if spans and lo <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        out += [(ent, "merged", a, b) for a, b in spans]
        out += [(ent, "gap", a[1] + 1, b[0] - 1) for a, b in zip(spans, spans[1:])]
    return sorted(out, key=str)


def check(spark, data):
    df = spark.createDataFrame(data, "t string, s long, e long").withColumn("lo", F.lit("clash")).withColumn("pid", F.lit(None).cast("int"))
    assert rows(spans_and_gaps(df, "t", "s", "e")) == brute(data)


def test_hot_entity_over_all_partitions(spark):
    rng = random.Random(1)
    data = [("hot", s := rng.randrange(60_000), s + rng.randrange(12)) for _ in range(4000)]
    data += [(f"t{i % 300}", s := rng.randrange(500), s + rng.randrange(-5, 60)) for i in range(3000)]
    check(spark, data)


def test_one_interval_spans_several_partitions(spark):
    data = [("a", 0, 10**6)] + [("a", i * 10, i * 10 + 3) for i in range(2000)] + [("b", 5, 6), ("b", 7, 7), ("b", 9, 9)]
    check(spark, data)


def test_nulls_repeats_nesting_and_empty(spark):
    check(spark, [(None, 1, 2), (None, 4, 5), ("x", None, 3), ("x", 3, None), ("x", 9, 2), ("", 1, 1), ("y", 1, 9), ("y", 1, 9), ("y", 2, 3), ("y", 11, 11), ("z", -5, -1), ("z", 0, 0)])
    check(spark, [])
