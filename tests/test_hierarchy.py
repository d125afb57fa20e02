import random

from pyspark.sql import functions as F

from guideloom import pipeline_queries
from guideloom.operators.hierarchy import CYCLE, descendant_pairs, hierarchy
from guideloom.plans.ordering import prefix_sums, with_next
from guideloom.plans.scratch import Scratch
from tests.conftest import rows


def brute(links):
    parent = {i: (p.strip() or None) if p else None for i, p in links.items()}
    parent = {i: p if p in parent else None for i, p in parent.items()}
    out = {}
    for i in parent:
        path, x = [], i
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        out[i] = (CYCLE, -1, None) if x is not None else (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, links, **options):
    data = [(i, p, n, n) for n, (i, p) in enumerate(links.items())]
    df = spark.createDataFrame(data, "id string, parent string, loaded_at long, row_id long").withColumn("num", F.lit("clash")).withColumn("size", F.lit(1))
    nodes = hierarchy(df, "id", "parent", ["loaded_at", "row_id"], paths=True, **options).collect()
    want = brute(links)
    assert {r.id: (r.root_id, r.node_depth, r.path) for r in nodes} == want
    places = [(r.root_id, x) for r in nodes if r.node_depth >= 0 for x in (r.entry, r.exit)]
    assert len(set(places)) == len(places) and all(x >= 0 for _, x in places)
    by = {r.id: r for r in nodes}
    for i, (_, depth, path) in want.items():
        if depth > 0:
            assert all(by[a].entry < by[i].entry < by[i].exit < by[a].exit for a in path[:-1])
    for r in nodes:
        if r.node_depth >= 0:
            assert r.descendants == sum(1 for _, _, p in want.values() if p and r.id in p[:-1]) == (r.exit - r.entry - 1) // 2
    return df


def test_random_forest_with_chains_cycles_and_hot_parent(spark):
    rng = random.Random(3)
    links = {f"n{i}": f"n{rng.randrange(max(1, i))}" if i % 9 else rng.choice([None, "", " ", "missing"]) for i in range(300)}
    links |= {f"c{i}": f" c{i - 1} " for i in range(1, 60)} | {"c0": None}
    links |= {f"h{i}": "n5" for i in range(200)}
    links |= {"x": "y", "y": "z", "z": "x", "w": "x", "v": "w", "self": "self", "under": "self"}
    check(spark, links)
    check(spark, links, block_bits=2)


def test_blocks_of_any_size_agree(spark):
    rng = random.Random(8)
    names = [f"{rng.randrange(10**9)}" for _ in range(90)]  # ids that tell nothing of the parents
    links = {x: names[max(0, i - 1 - rng.randrange(3))] if i % 30 else None for i, x in enumerate(names)}
    links |= {"p": "q", "q": "p", "r": "q", names[7]: names[9], names[9]: names[7]}
    for bits in (0, 3):
        check(spark, links, block_bits=bits)


def test_pairs_latest_row_and_empty(spark):
    data = [("a", None, 1, 1), ("b", "a", 1, 2), ("b", "c", None, 9), ("c", "b", 5, 1), ("c", "a", 5, 0), (None, "a", 1, 1)]
    df = spark.createDataFrame(data, "id string, parent string, loaded_at long, row_id long")
    nodes = hierarchy(df, "id", "parent", ["loaded_at", "row_id"], paths=True)
    assert rows(nodes.select("id", "root_id", "node_depth")) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]
    assert rows(descendant_pairs(nodes)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert rows(hierarchy(df.where("false"), "id", "parent", ["loaded_at"])) == []


def test_query_gives_the_descendants_that_the_intervals_hold(spark, tmp_path):
    data = [(f"n{i}", f"n{i // 3}" if i else None, 1, i) for i in range(40)] + [("x", "y", 1, 90), ("y", "x", 1, 91), ("under", "x", 1, 92), ("alone", None, 1, 93)]
    df = spark.createDataFrame(data, "id string, parent string, loaded_at long, row_id long")
    df.write.parquet(str(tmp_path / "annotation_features.parquet"))
    nodes = [r for r in hierarchy(df, "id", "parent", ["loaded_at", "row_id"]).collect() if r.node_depth >= 0]
    want = sorted((a.id, x.id, x.node_depth - a.node_depth) for a in nodes for x in nodes if a.root_id == x.root_id and a.entry < x.entry < a.exit)
    assert sorted(map(tuple, pipeline_queries.QUERIES["p5_descendants"](spark, str(tmp_path)).select("ancestor_id", "id", "distance").collect())) == want != []


def test_prefix_sums_and_next_over_partitions(spark):
    rng = random.Random(5)
    data = [(0 if rng.random() < 0.6 else rng.randrange(40), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g long, i long, v long").repartition(7)
    sums, seen, last, following = {}, {}, {}, {}
    for g, i, v in sorted(data):
        sums[(g, i)] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
        following[(g, last.get(g))] = i
        last[g] = i
    scratch = Scratch(spark, "test")
    assert {(r.g, r.i): r.before for r in prefix_sums(df, scratch, "g", "i", "v").collect()} == sums
    assert all(following.get((r.g, r.i)) == r.next for r in with_next(df, scratch, "g", "i").collect())
