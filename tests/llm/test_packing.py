import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from guideloom.llm.packing import best_fit, pack_items
from tests.conftest import rows


def pack(spark, data, capacity, **options):
    df = spark.createDataFrame(data, "id long, n long").withColumn("size", F.lit("clash")).withColumn("bin", F.lit(1))
    got = pack_items(df, "id", "n", capacity, **options).collect()
    fill, held = Counter(), Counter()
    for r in got:
        fill[r.container_id] += r.size
        held[r.id] += r.size
    assert max(fill.values(), default=0) <= capacity
    want = Counter()
    for i, n in data:
        want[i] += max(n or 0, 0)
    assert dict(held) == dict(want)
    return got, fill


def test_little_room_is_left_over_many_rounds(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 1000), 700])) for i in range(3000)]
    got, fill = pack(spark, data, 1000, bins_per_task=200)
    lower = -(-sum(n for _, n in data) // 1000)
    assert len(fill) <= 1.15 * max(lower, sum(n > 500 for _, n in data))
    assert all(r.part == 0 and r.start == 0 for r in got)


def test_items_that_never_fit_together_end(spark):
    got, fill = pack(spark, [(i, 501) for i in range(900)], 1000, bins_per_task=50)
    assert len(fill) == 900


def test_only_oversized_items_are_divided(spark):
    got, fill = pack(spark, [(1, 2500), (2, 1000), (3, 500), (4, 0), (5, None), (6, -4), (7, 10**6)], 1000)
    assert sorted((r.part, r.start, r.size) for r in got if r.id == 1) == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 500)]
    assert len(fill) == 1004 and {r.id for r in got if r.size == 0} == {4, 5, 6}
    assert all(fill[r.container_id] > 0 for r in got)


def test_repeats_only_empty_items_and_empty(spark):
    got, fill = pack(spark, [(1, 3), (1, 3), (2, 5)], 10)
    assert len(got) == 3 and len(fill) == 2
    got, _ = pack(spark, [(i, 0) for i in range(9)], 10)
    assert len(got) == 9
    assert pack(spark, [], 10)[0] == []
    with pytest.raises(ValueError):
        pack_items(spark.createDataFrame([], "id long, n long"), "id", "n", 0)


def test_best_fit_takes_the_fullest_bin():
    assert best_fit([6, 5, 4, 3, 2], 10) == ([0, 1, 0, 1, 1], [10, 10])
    assert rows is not None
