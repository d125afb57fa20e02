import itertools
import random

import pytest
from pyspark.sql import functions as F

from guideloom.functions import sequences as S
from guideloom.functions.scoring import best_alignments, event_distance, score_text
from guideloom.operators import hits as H
from guideloom.operators import search as search_module
from guideloom.operators.extraction import extract_sites, genome, sites_by_name, slices
from guideloom.operators.scored import padded_targets, scored_hits
from guideloom.operators.search import indel_hits, indel_pairs, mismatch_hits, mismatch_pairs, raw_search, search
from guideloom.params import SearchParams
from tests.conftest import rows

T = "ACGTACGTTAGGCCATTGCAACGGTTAACCGGATATCGCGNNAGGTTT"
GOLDEN = {
    ("up", ""): "2-9:+ CGTACGTT,14-21:+ CATTGCAA,22-29:+ CGGTTAAC,35-42:+ ATCGCGNN,16-23:- CGTTGCAA,32-39:- GCGATATC",
    ("up", "NAG"): "2-9:+ CGTACGTT,14-21:+ CATTGCAA,22-29:+ CGGTTAAC,35-42:+ ATCGCGNN,16-23:- CGTTGCAA,32-39:- GCGATATC,1-8:+ ACGTACGT,34-41:+ TATCGCGN",
    ("down", ""): "13-20:+ CCATTGCA,25-32:+ TTAACCGG,33-40:+ ATATCGCG,5-12:- CCTAACGT,21-28:- TTAACCGT",
    ("down", "NAG"): "13-20:+ CCATTGCA,25-32:+ TTAACCGG,33-40:+ ATATCGCG,5-12:- CCTAACGT,21-28:- TTAACCGT,12-19:+ GCCATTGC",
}


def contigs(spark, data):
    return genome(spark.createDataFrame(data, "chrom_idx long, chrom_name string, chrom_sequence string"))


@pytest.mark.parametrize("tile", [5, 16, 1000])
def test_golden_sites_whatever_the_tile(spark, tile):
    df = contigs(spark, [(0, "T", T.lower()), (1, "short", "ACG"), (2, "n", "N" * 40), (3, None, None), (4, "e", "")])
    for (direction, alt), want in GOLDEN.items():
        got = extract_sites(df, SearchParams(spacer_length=8, direction=direction, alt_pam=alt), True, tile=tile)
        assert rows(got.select("name", "seq")) == sorted(tuple(f"T:{x}".split()) for x in want.split(","))


def test_sample_query(spark):
    got = extract_sites(contigs(spark, [(0, "QUERY", "TTCTCGAGCGTCGCGTGGAGTCCGG")]), SearchParams(), False)
    assert rows(got.select("name", "seq", S.dust_score(F.col("seq")))) == [("QUERY:3-22:+", "CTCGAGCGTCGCGTGGAGTC", 5)]


def test_iupac_is_opt_in(spark):
    df = contigs(spark, [(0, "c", "A" * 10 + "CGA" + "A" * 10)])
    plain = extract_sites(df, SearchParams(pam="NGR", alt_pam="", spacer_length=5), False, dust=False).where("not is_reverse")
    expanded = extract_sites(df, SearchParams(pam="NGR", alt_pam="", spacer_length=5, iupac=True), False, dust=False).where("not is_reverse")
    assert plain.count() == 0 and expanded.count() == 1


def complement(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(s))


def test_expressions_equal_python(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN" if i % 3 else "AC") for _ in range(rng.randrange(1, 33))) for i in range(200)] + ["T" * 32, "A", ""]
    df = spark.createDataFrame([(s, seqs[-1 - i]) for i, s in enumerate(seqs)], "a string, b string")
    c = F.col("a")
    got = df.select("a", "b", S.reverse_complement(c).alias("rc"), S.dust_score(c).alias("dust"), S.code_2bit(c).alias("code"), S.strict_code(c).alias("strict"), S.channel(c, "G").alias("g"), S.hamming(c, F.col("b")).alias("h"), S.base_number(F.substring(c, 1, 1)).alias("n"), *S.base_counts(c)).collect()
    for r in got:
        s = r.a
        triples = [s[i : i + 3] for i in range(len(s) - 2) if "N" not in s[i : i + 3]]
        code = sum(max("ACGT".find(x), 0) << 2 * k for k, x in enumerate(reversed(s)))
        code -= (code >> 63) << 64
        assert r.rc == complement(s) and complement(r.rc) == s
        assert r.dust == sum(triples.count(t) * (triples.count(t) - 1) // 2 for t in set(triples))
        assert r.code == code and r.strict == (code if s and "N" not in s else None)
        assert r.g == sum((x == "G") << k for k, x in enumerate(reversed(s)))
        assert r.h == (sum(x != y for x, y in zip(s, r.b)) if len(s) == len(r.b) else -1)
        assert r.n == "ACGT".find(s[0]) if s else r.n == -1
        assert (r.n_a, r.n_c, r.n_g, r.n_t) == tuple(s.count(x) for x in "ACGT")


def anchored(q, t, limit):
    """Plain table: either side's first characters may be left out, up to the limit."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    best = min([edits(q, t)] + [edits(q[k:], t) for k in range(1, limit + 1)] + [edits(q, t[k:]) for k in range(1, limit + 1)])
    return best if best <= limit else None


def mutated(rng, s):
    s = list(s)
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], [rng.choice("ACGTN")], [rng.choice("ACGT"), s[i]]])
    return ("".join(s) + "ACGTACGTACGT")[:12] if rng.random() < 0.5 else ("ACGTACGTACGT" + "".join(s))[-12:]


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_seed_joins_equal_all_pairs(spark, limit):
    rng = random.Random(limit)
    base = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(12)] + ["A" * 12, "AC" * 6]
    queries, targets = [mutated(rng, rng.choice(base)) for _ in range(40)] + base, [mutated(rng, rng.choice(base)) for _ in range(160)] + base
    frame = lambda x: spark.createDataFrame([(s, "clash") for s in x], "seq string, key string")
    a = lambda s: s.replace("N", "A")
    want = {(q, t, d) for q in queries for t in targets if (d := sum(x != y for x, y in zip(a(q), a(t)))) <= limit}
    shuffled = {"broadcast_bytes": 0, "salts": 3}
    assert set(rows(mismatch_pairs(frame(queries), frame(targets), 12, limit))) == want == set(rows(mismatch_pairs(frame(queries), frame(targets), 12, limit, **shuffled)))
    want = {(q, t, d) for q in queries for t in targets if (d := anchored(q, t, limit)) is not None}
    assert set(rows(indel_pairs(frame(queries), frame(targets), 12, limit))) == want == set(rows(indel_pairs(frame(queries), frame(targets), 12, limit, **shuffled)))
    named = lambda x: spark.createDataFrame([(f"{s}{i % 2}", s) for i, s in enumerate([*x, x[0]])], "name string, seq string").withColumn("mark", F.lit("clash"))
    once, other = (rows(indel_hits(named(queries), named(targets), 12, limit, broadcast_bytes=b)) for b in (1 << 20, 0))
    assert once == other and {(x[1], x[3], x[4]) for x in once} == want and len(set(once)) == len(once)


def sites_of_few_names(spark):
    """Queries and targets of which some names have several sequences, some rows are repeated and some names null."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(4)] + ["A" * 12]
    frame = lambda x: spark.createDataFrame(x, "name string, seq string")
    queries = [(f"q{i if i < 20 else 0}", mutated(rng, rng.choice(base))) for i in range(24)] + [(None, base[0]), ("short", "ACGT"), ("none", None)]
    targets = [(f"t{rng.randrange(60)}", mutated(rng, rng.choice(base))) for _ in range(150)] + [(None, base[0]), (None, mutated(rng, base[0])), ("none", None)]
    return frame(queries), frame(targets + targets[:20])


@pytest.mark.parametrize("max_indel", [0, 2])
def test_raw_search_equals_raw_hits_of_all_hits(spark, max_indel):
    queries, targets = sites_of_few_names(spark)
    want = rows(H.raw_hits(search(queries, targets, 12, 3, max_indel)))
    assert want and any(x[-1] > 1 for x in want)
    for some in ({}, {"lost_rows": 0}, {"broadcast_bytes": 0}):
        got = raw_search(queries, targets, 12, 3, max_indel, **some)
        assert rows(got.select(*H.HIT_COLUMNS, "genomic_frequency")) == want


def test_raw_search_shuffles_no_hits(spark):
    # 90,000 hits of 300 queries and 300 targets: the plan that makes them, behind the written targets, exchanges nothing.
    site = "ACGTTGCAAGCT"
    queries, targets = (spark.range(300).select(F.concat(F.lit(x), F.col("id")).alias("name"), F.lit(site).alias("seq")) for x in "qt")
    found = raw_search(queries, targets, 12, 3, 1)
    assert found.where("genomic_frequency = 300 and search_type = 'Exact'").count() == 90_000
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_mismatch_hits_broadcast_no_keys(spark, monkeypatch):
    # What the driver gathers are rows of queries, not one row for each of their keys.
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    queries, targets = sites_of_few_names(spark)
    assert mismatch_hits(queries, targets, 12, 3).count() > 0
    assert len(sent) == 1 and sent[0] <= queries.count()


def sites_of_contigs(spark):
    """Queries and the contigs of their targets: delivered again, with other bases, without a name, with unknown bases."""
    rng = random.Random(7)
    bases = "".join(rng.choice("ACGT") for _ in range(300)) + "GATTACATTGCAGG" * 4 + "NNANN" + "ACGTTGCAAGCTTGG" * 3
    other = bases[:150] + "".join(rng.choice("ACGT") for _ in range(150)) + bases[300:]
    df = contigs(spark, [(0, "a", bases), (1, "b", bases), (2, "a", bases.lower()), (3, "a", other), (4, None, bases), (5, None, other), (6, "c:1", bases[40:]), (7, "d", "ACG")])
    sites = extract_sites(df, SearchParams(spacer_length=12), True).select("seq").distinct().collect()
    queries = [(f"q{i}", r.seq if i % 3 else mutated(rng, r.seq)) for i, r in enumerate(sorted(sites))]
    return spark.createDataFrame([*queries, ("again", queries[0][1]), (None, queries[1][1])], "name string, seq string"), df


@pytest.mark.parametrize("tile", [7, 64, 5000])
def test_sites_by_name_hold_every_site(spark, tile):
    _, df = sites_of_contigs(spark)
    for direction in ("up", "down"):
        p = SearchParams(spacer_length=12, direction=direction)
        got = sites_by_name(df, p, True, tile=tile, task_bases=200)
        assert rows(got.select("name", "seq", "chrom_idx")) == rows(extract_sites(df, p, True).select("name", "seq", "chrom_idx"))
        at = got.withColumn("task", F.spark_partition_id()).groupBy("name").agg(F.count_distinct("task", "part").alias("n"))
        assert at.where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sites_by_name(df, SearchParams(alt_pam="NNAG"), True)


@pytest.mark.parametrize("tested", [1, 40, 1 << 16])
def test_whole_parts_hold_each_site_once(spark, monkeypatch, tested):
    monkeypatch.setattr(search_module, "TESTED", tested)
    _, df = sites_of_contigs(spark)
    table = sites_by_name(df, SearchParams(spacer_length=12), True, tile=64, task_bases=10**6).toArrow()
    tables = list(search_module._whole_parts(iter(table.to_batches(max_chunksize=9))))
    got = [(r["name"], r["seq"]) for t in tables for r in t.to_pylist()]
    assert sorted(got, key=str) == sorted({(r["name"], r["seq"]) for r in table.to_pylist()}, key=str)
    parts = [{r["part"] for r in t.to_pylist()} for t in tables]
    assert sum(map(len, parts)) == len(set().union(*parts))
    for name, some in itertools.groupby(got, lambda x: x[0]):
        some = list(some)
        assert some == sorted(some, key=str) and len(some) == sum(x[0] == name for x in got)


def test_hits_in_blocks_shuffle_no_targets(spark, monkeypatch):
    # More queries than are sent at once: they are divided, and what is shuffled are tiles of the genome only.
    monkeypatch.setattr(search_module, "_shuffled_pairs", None)
    queries, df = sites_of_contigs(spark)
    p = SearchParams(spacer_length=12)
    for hits_of, limit in ((mismatch_hits, 3), (indel_hits, 1)):
        want = rows(hits_of(queries, extract_sites(df, p, True), 12, limit))
        got = hits_of(queries, sites_by_name(df, p, True, task_bases=200), 12, limit, broadcast_bytes=queries.count() * 40, by_name=True)
        assert want and rows(got) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 3 and "Aggregate" not in plan


def test_raw_search_by_name_writes_no_targets(spark, monkeypatch):
    # Targets of one sequence a name stay where they are found; other ones are still searched whole.
    queries, df = sites_of_contigs(spark)
    p, written = SearchParams(spacer_length=12), search_module._hit_targets
    for some, way in ((df.where("chrom_idx in (0, 1, 2, 6, 7)"), None), (df, written)):
        monkeypatch.setattr(search_module, "_hit_targets", written)
        want = rows(H.raw_hits(search(queries, extract_sites(some, p, True), 12, 3, 1)))
        monkeypatch.setattr(search_module, "_hit_targets", way)
        got = raw_search(queries, sites_by_name(some, p, True, task_bases=200), 12, 3, 1, broadcast_bytes=queries.count() * 70, by_name=True)
        assert any(x[-1] > 1 for x in want) and rows(got.select(*H.HIT_COLUMNS, "genomic_frequency")) == want


Q = "CTCGAGCGTCGCGTGGAGTC"
SCORES = [
    ("TTCTCGAGCGTCGCGTGGAGTC", 47, "1.0", []),
    ("TTATCGAGCGTCGCGTGGAGTC", 7, "0.9075", [("sub", -20, "C", "A")]),
    ("TTCTCGAGCGTCGCGTGGAGTA", 4, "0.309", [("sub", -1, "C", "A")]),
    ("TTCTCGAGCGTCATGTGGAGTC", 1, "0.0724903564815", [("sub", -10, "G", "A"), ("sub", -9, "C", "T")]),
    ("TTATCGACCGTCACGTGTAGTC", 1, "0.000378453938027", [("sub", -20, "C", "A"), ("sub", -15, "G", "C"), ("sub", -10, "G", "A"), ("sub", -5, "G", "T")]),
    ("ATTCTCGAGCGTCCGTGGAGTC", 4, "0.1365", [("del", -10, "G", "-")]),
    ("TCTCGAGCGTCAGCGTGGAGTC", 4, "0.158", [("ins", -11, "-", "A")]),
]


def best(query, target, indels, mismatches, upstream):
    return best_alignments([query], [target], indels, mismatches, upstream).to_pylist()[0]


def plain_paths(q, t, indels, mismatches):
    """Every alignment anchored at the start, in the order of preference: walked base by base."""

    def walk(i, j, subs, gaps, events):
        if i == len(q):
            yield events
            return
        if j < len(t):
            same = q[i] == t[j]
            if same or subs < (indels - gaps if gaps else mismatches):
                yield from walk(i + 1, j + 1, subs + (not same), gaps, events if same else [*events, ("sub", i + 1, q[i], t[j])])
        if subs + gaps < indels:
            yield from walk(i + 1, j, subs, gaps + 1, [*events, ("del", i + 1, q[i], "-")])
            if j < len(t):
                yield from walk(i, j + 1, subs, gaps + 1, [*events, ("ins", i + 1, "-", t[j])])

    return list(walk(0, 0, 0, 0, []))


def plain_score(events):
    z, before, n = 1.0, 99, len(events)
    for op, pos, _, _ in sorted(events):
        i = abs(pos)
        w = 0.0014 * i * i + 0.0021 * i + 0.3055
        if op != "sub":
            z = z * (w - 0.23 - i * 0.01) / n
        else:
            z = 1e-7 if n > 4 else z * w / {1: 1.0, 2: 1.8, 3: 1.8, 4: 4.0}[n]
        z, before = z * 1.15 if abs(i - before) == 1 else z, i
    return z


def plain_best(query, target, indels, mismatches, upstream):
    q, t = (query[::-1], target[::-1]) if upstream else (query, target)
    found = None
    for events in plain_paths(q, t, indels, mismatches):
        if upstream:
            events = [(op, -pos, a, b) for op, pos, a, b in events]
        score = plain_score(events)
        if found is None or score > found[0]:
            found = score, events[::-1] if upstream else events
        if score == 1.0:
            break
    return found


def as_pair(got):
    return None if got["score"] is None else (got["score"], [tuple(e.values()) for e in got["details"]])


def test_golden_scores():
    for target, paths, score, events in SCORES:
        assert len(plain_paths(Q[::-1], target[::-1], 2, 4)) == paths
        got = as_pair(best(Q, target, 2, 4, True))
        assert (score_text(got[0]), got[1]) == (score, events)
    assert as_pair(best(Q, "TTAGTGAGCGTCATGTGGAGTC", 2, 4, True)) is None
    assert as_pair(best(Q, "ATCGAGCGTCGCGTGGAGTCTT", 2, 4, False)) == (0.309, [("sub", 1, "C", "A")])


@pytest.mark.parametrize("indels,mismatches", [(0, 0), (0, 5), (1, 2), (2, 4), (3, 6)])
def test_best_alignments_equal_all_paths(indels, mismatches):
    rng = random.Random(indels)
    queries, targets = [], []
    for _ in range(150):
        q = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 7, 10, 12] if indels == 3 else [1, 3, 20, 20, 24, 31, 32])))
        t = list(q)
        for _ in range(rng.randrange(4)):
            if t:
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice("ACGTN")], [rng.choice("ACGT"), t[i]]])
        t = "".join(t)
        queries.append(rng.choice([q, "A" * len(q)]) if rng.random() < 0.2 else q)
        targets.append(rng.choice([t, "AC"[: rng.randrange(3)] + t, t[: rng.randrange(len(t) + 1)], "A" * len(t) + "AA", t + "GT"]))
    queries, targets = [*queries, None, "A", "", "ACG"], [*targets, "A", None, "A", ""]
    for upstream in (True, False):
        got = [as_pair(x) for x in best_alignments(queries, targets, indels, mismatches, upstream).to_pylist()]
        want = [None if q is None or t is None else plain_best(q, t, indels, mismatches, upstream) for q, t in zip(queries, targets)]
        assert got == want


def plain_event_distance(a, b, limit):
    table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j - 1] + (x != y), table[i - 1][j] + 1, table[i][j - 1] + 1)
    if table[-1][-1] > limit:
        return table[-1][-1]
    i, j, run, events = len(a), len(b), False, 0
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            events, run, i, j = events + (a[i - 1] != b[j - 1]), False, i - 1, j - 1
        else:
            events, run = events + (not run), True
            if i and table[i][j] == table[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
    return events


def test_event_distance(spark):
    rng = random.Random(9)
    pairs = [("ACGT", "ACGT"), ("ACGT", "AGGT"), ("AAACCC", "AAA"), ("AAACCC", "TTTGGG"), ("", ""), ("", "ACG"), ("ACGTACGT", "ACGACGTT"), ("A" * 3000, "A" * 2998 + "C"), (None, "A"), ("A", None)]
    for _ in range(200):
        s = "".join(rng.choice("AC") for _ in range(rng.randrange(8, 15)))
        pairs.append((s, mutated(rng, s) if rng.random() < 0.7 else s[: rng.randrange(len(s))]))
    df = spark.createDataFrame(pairs, "a string, b string")
    for limit in (0, 1, 4, 30):
        got = df.select("a", "b", event_distance(F.col("a"), F.col("b"), limit).alias("e")).collect()
        assert all(r.e == (None if r.a is None or r.b is None else plain_event_distance(r.a, r.b, limit)) for r in got if len(r.a or "") < 1000)
    assert df.where("length(a) = 3000").select(event_distance(F.col("a"), F.col("b"), 4)).first()[0] == 2


def test_padded_targets_and_scored_hits(spark):
    left = "GATTACA" + "TT" + Q + "CGG"
    df = contigs(spark, [(0, "c:1", "ACGT"), (1, "c:1", left + "ACGTACG" + complement(left)), (2, "edge", Q + "CGG")])
    n = len(left)
    names = [f"c:1:{8 + 2}-{8 + 21}:+", f"c:1:{n + 7 + 4}-{n + 7 + 23}:-", "edge:1-20:+", "edge:10-40:+", "gone:1-20:+", "bad", None, "edge:0-5:+"]
    got = dict(rows(padded_targets(spark.createDataFrame([(x,) for x in names] * 2, "target_name string"), df, SearchParams())))
    assert got == {names[0]: "TT" + Q, names[1]: "TT" + Q, names[2]: Q}
    hits = spark.createDataFrame([("q", Q.lower(), x, "t", 9, "Indel", 1) for x in names] + [("q", None, names[0], "t", 1, "Exact", 1), ("q", "A" * 20, names[0], "t", 1, "Exact", 1)], "query_name string, query_seq string, target_name string, target_seq string, distance int, search_type string, genomic_frequency int")
    scored = scored_hits(hits, df, SearchParams()).collect()
    assert {(r.target_name, r.distance, r.search_type, r.score, r.details) for r in scored} == {(x, 0, "Exact", 1.0, "[]") for x in names[:3]}


def test_slices_over_tiles(spark):
    df = contigs(spark, [(0, "a", "ACGTTGCA" * 9)])
    wanted = spark.createDataFrame([(i, "a", i, i + 30, i + 30) for i in range(50)] + [(90, "a", 5, 5, 5), (91, "a", -1, 4, 4)], "item long, chrom string, lo long, hi long, need long")
    assert dict(rows(slices(wanted, df, tile=7))) == {i: ("ACGTTGCA" * 9)[i : i + 30] for i in range(43)}


def test_union_frequency_and_filters(spark):
    data = [("q", "A", "t1", "X", 2, "Indel"), ("q", "A", "t1", "X", 3, "Mismatch"), ("q", "A", "t2", "X", 0, "Exact"), (None, "A", "t2", None, None, "Indel"), (None, "A", "t2", None, None, "Indel"), ("q", "A", None, "X", 1, "Indel")]
    df = spark.createDataFrame(data, "query_name string, query_seq string, target_name string, target_seq string, distance int, search_type string")
    assert rows(H.raw_hits(df)) == sorted([("q", "A", "t1", "X", 3, "Mismatch", 3), ("q", "A", "t2", "X", 0, "Exact", 3), (None, "A", "t2", None, None, "Indel", 1), ("q", "A", None, "X", 1, "Indel", 3)], key=str)
    assert rows(H.count_filter(df, "target_seq", 1)) == []
    assert rows(H.over_represented(df, "target_seq", 1)) == [("X", 4, ">count_4\nX")]
    assert rows(H.on_target_filter(df.withColumn("id", F.lit(1)), H.sequence_counts(df, "query_seq"), "id", "target_seq")) == [(1, "X", 0)]
    assert H.raw_hits(df.where("false")).count() == 0


def test_query_summary(spark):
    data = [("q", "t1", "Exact", 1.0), ("q", "t1", "Mismatch", 0.5), ("q", "t2", "Indel", 2.0), ("r", "t", "Indel", 0.25), ("r", None, "Mismatch", float("nan")), ("r", "u", "Mismatch", None), ("s", "t", "Indel", 2.5), (None, "t", "Exact", 1.0)]
    got = {r.query_name: tuple(r)[1:] for r in H.query_summary(spark.createDataFrame(data, "query_name string, target_name string, search_type string, score double")).collect()}
    assert got["q"] == (3, 1, 1, 1, 2, 0.0, True) and got["r"][:5] == (3, 0, 2, 1, 2)
    assert got["r"][5] == pytest.approx(0.875) and got["s"][5] == pytest.approx(-0.25) and len(got) == 3


def test_parameters():
    for bad in ({"pam": ""}, {"direction": "x"}, {"spacer_length": 33}, {"max_indel": -1}):
        with pytest.raises(ValueError):
            SearchParams(**bad)
