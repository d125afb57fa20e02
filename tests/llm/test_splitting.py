import random
import re

import pytest
from pyspark.sql import functions as F

from guideloom.llm.splitting import balanced_pieces, best_pieces, sites_in_pieces, split_sequences
from tests.conftest import rows


def rule(text, size=60, least=30, overlap=5, run=4):
    """The leftmost rule, piece by piece."""
    ends = [m.end() for m in re.finditer("[Nn]+", text) if m.end() - m.start() >= run]
    out, s = [], 0
    while len(text) - s > size:
        e = max([x for x in ends if s + least < x <= s + size], default=s + size)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(text))]


def sequence(rng, n):
    return "".join(rng.choice(["ACGT", "acgt", "N" * rng.randrange(1, 9), "n" * rng.randrange(3, 6), "G"]) for _ in range(n))


OPTIONS = {"max_size": 60, "min_size": 30, "overlap": 5, "gap_run": 4}


def test_leftmost_equals_the_rule_and_pieces_cover(spark):
    rng = random.Random(2)
    data = [(i, sequence(rng, rng.randrange(1, 120))) for i in range(150)] + [(900, None), (901, ""), (902, "N" * 500), (903, "A" * 60), (904, "A" * 61), (904, "A" * 61), (905, "é" * 100 + "NNNN" + "ü" * 80), (906, "ACGT" * 50_000)]
    df = spark.createDataFrame(data, "id long, s string").withColumn("pieces", F.lit("clash")).withColumn("key", F.lit(1))
    got = split_sequences(df, "id", "s", with_text=True, **OPTIONS)
    want = [(i, a, b, s[a:b]) for i, s in data if s for a, b in rule(s)]
    assert rows(got) == sorted(want, key=str)
    longer = split_sequences(df, "id", "s", longer_than=60, **OPTIONS)
    assert rows(longer) == sorted([(i, a, b) for i, s in data if s and len(s) > 60 for a, b in rule(s)], key=str)


def cost(pieces, cuts, target=45.0):
    return sum(((b - a - target) / target) ** 2 + (b not in cuts) for a, b in pieces[:-1])


def test_total_objective_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 400)
        cuts = sorted(rng.sample(range(1, n + 1), rng.randrange(0, min(n, 30))))

        def all_plans(s):
            if n - s <= 60:
                return [[(s, n)]]
            ends = [e for e in cuts if s + 30 < e <= s + 60] or [s + 60]
            return [[(s, e), *rest] for e in ends for rest in all_plans(e - 5)]

        got = best_pieces(n, cuts, 60, 30, 5, "total")
        assert cost(got, cuts) == pytest.approx(min(cost(p, cuts) for p in all_plans(0))) if n < 200 else got[-1][1] == n
        assert got[0][0] == 0 and all(b - a <= 60 for a, b in got) and all(y[0] == x[1] - 5 for x, y in zip(got, got[1:]))


def test_balanced_counts_the_last_piece_and_all_cuts(spark):
    rng = random.Random(6)
    for size, least, overlap in ((12, 5, 2), (12, 9, 2), (20, 4, 0), (14, 6, 5)):
        target = (size + least) / 2
        for n in [*range(1, 70), 150]:
            cuts = sorted(rng.sample(range(1, n + 1), rng.randrange(0, min(n, 12))))
            off = lambda x: ((x - target) / target) ** 2  # noqa: B023, E731
            to_end = {}
            for s in range(n - overlap - 1, -1, -1):
                plans = [off(n - s)] if n - s <= size else []
                plans += [off(e - s) + (e not in cuts) + to_end[e - overlap] for e in range(s + least + 1, min(s + size, n - 1) + 1)]
                to_end[s] = min(plans)
            got = balanced_pieces(n, cuts, size, least, overlap)
            if n <= size:
                assert got == [(0, n)]
                continue
            assert sum(off(b - a) for a, b in got) + sum(b not in cuts for _, b in got[:-1]) == pytest.approx(to_end[0])
            assert got[0][0] == 0 and got[-1][1] == n and all(y[0] == x[1] - overlap for x, y in zip(got, got[1:]))
            assert all(least < b - a for a, b in got[:-1]) and all(b - a <= size for a, b in got)
    df = spark.createDataFrame([(1, "A" * 6100)], "id long, s string")
    assert rows(split_sequences(df, "id", "s", objective="balanced")) == [(1, 0, 3075), (1, 3025, 6100)]


def test_sites_lie_whole_in_a_piece(spark):
    df = spark.createDataFrame([(1, "A" * 300), (2, "A" * 10), (3, None)], "id long, s string")
    sites = spark.createDataFrame([(i, 1, i * 3, 5) for i in range(98)] + [(900, 2, 5, 5), (901, 2, 6, 5), (902, 3, 0, 5), (903, None, 0, 5), (904, 1, None, 5)], "site long, id long, pos long, n int")
    got = {r.site: (r.piece_start, r.piece_end) for r in sites_in_pieces(sites, split_sequences(df, "id", "s", **OPTIONS), "id", "pos", "n", "site", bucket=7).collect()}
    pieces = rule("A" * 300)
    assert all(got[i] == next(p for p in pieces if p[0] <= i * 3 and i * 3 + 5 <= p[1]) for i in range(98))
    assert got[900] == (0, 10) and got[901] == got[902] == got[903] == got[904] == (None, None)


def test_parameters_and_empty(spark):
    df = spark.createDataFrame([], "id long, s string")
    assert rows(split_sequences(df, "id", "s")) == []
    for bad in ({"overlap": 40}, {"min_size": 70}, {"objective": "other"}):
        with pytest.raises(ValueError):
            split_sequences(df, "id", "s", **(OPTIONS | bad))
