import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guideloom.llm import ngrams
from guideloom.llm.ngrams import ngram_counts


def brute(data, max_n, min_n):
    times, holders = Counter(), defaultdict(set)
    for rec, toks in data:
        if rec is None or toks is None:
            continue
        toks = toks if isinstance(toks, str) else ["" if t is None else t for t in toks]
        for n in range(min_n, max_n + 1):
            for i in range(len(toks) - n + 1):
                gram = toks[i : i + n] if isinstance(toks, str) else tuple(toks[i : i + n])
                times[gram] += 1
                holders[gram].add(rec)
    return {g: (len(g), c, len(holders[g])) for g, c in times.items()}


def check(spark, data, kind, max_n, min_n=1):
    df = spark.createDataFrame(data, f"r string, t {kind}").withColumn("n", F.lit("clash")).withColumn("suffix", F.lit(1))
    got = ngram_counts(df, F.col("t"), F.col("r"), max_n, min_n, F.col("r")).collect()
    table = {g.ngram if isinstance(g.ngram, str) else tuple(g.ngram): (g.n, g.occurrences, g.records) for g in got}
    assert len(table) == len(got) and table == brute(data, max_n, min_n)


@pytest.mark.parametrize("block", [7, 200_000])
@pytest.mark.parametrize("max_n,min_n", [(1, 1), (3, 1), (4, 2)])
def test_hot_terms_over_partitions_and_blocks(spark, monkeypatch, block, max_n, min_n):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    rng = random.Random(block)
    data = [(f"r{rng.randrange(60)}", [rng.choice(["hot", "hot", "a", "b", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 9))]) for _ in range(300)]
    check(spark, data, "array<string>", max_n, min_n)


def test_characters(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 50)
    rng = random.Random(9)
    data = [(f"r{rng.randrange(20)}", "".join(rng.choice("AAACGTé字😕") for _ in range(rng.randrange(0, 25)))) for _ in range(200)]
    check(spark, data, "string", 4, 2)


def test_nulls_repeats_long_and_empty(spark):
    check(spark, [(None, ["a"]), ("x", None), ("x", []), ("x", ["a", None, "a"]), ("x", ["a", None, "a"]), ("y", ["", "a" * 5000])], "array<string>", 2)
    check(spark, [], "array<string>", 2)
    check(spark, [("x", ""), ("x", None), ("y", "A" * 3000)], "string", 3)
    with pytest.raises(ValueError):
        ngram_counts(spark.createDataFrame([], "r string, t string"), F.col("t"), F.col("r"), 2, 3)
