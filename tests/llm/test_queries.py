import os
from collections import Counter

import pytest

from guideloom.llm.lookalikes import compiled_mapping, transducer
from guideloom.llm.queries import CONTAINER_TOKENS, QUERIES, SQL
from guideloom.llm.tokenize import vocabulary_path
from tests.conftest import TABLES, against_sql, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES) or not os.path.exists(vocabulary_path()), reason="no test tables or vocabulary")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    against_sql(spark, QUERIES[name], SQL[name])


def test_tokens_and_containers(spark):
    done = {r.doc_id: r for r in QUERIES["p8_roundtrip"](spark, TABLES).collect()}
    ids = {r.doc_id: r.ids for r in QUERIES["p8_ids"](spark, TABLES).collect()}
    assert ids.keys() == done.keys() and all(r.same and r.n_tokens == len(ids[i]) for i, r in done.items())
    fill, held = Counter(), Counter()
    for r in QUERIES["p9_bins"](spark, TABLES).collect():
        fill[r.container_id] += r.size
        held[r.doc_id] += r.size
    assert dict(held) == {i: len(x) for i, x in ids.items()} and max(fill.values()) <= CONTAINER_TOKENS
    assert len(fill) <= -(-sum(fill.values()) // CONTAINER_TOKENS) + 1


def test_look_alike_documents(spark):
    form, texts = transducer(compiled_mapping()), {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    known = [(i, t, form(t)) for i, t in sorted(texts.items()) if t]
    assert rows(QUERIES["p10_found"](spark, TABLES)) == sorted([(a, b) for a, x, f in known for b, y, g in known if a < b and f == g and x != y], key=str)
    assert dict(rows(QUERIES["p10_texts"](spark, TABLES))) == {i: t and form(t) for i, t in texts.items()}


def test_pieces_put_contigs_together(spark):
    text = {r.chrom_idx: r.chrom_sequence for r in spark.read.parquet(f"{TABLES}/contigs.parquet").collect() if r.chrom_sequence}
    end = {}
    for idx, a, b, piece in sorted(QUERIES["p2_pieces"](spark, TABLES).collect()):
        assert piece == text[idx][a:b] and b - a <= 6000 and a == max(0, end.get(idx, 0) - (50 if idx in end else 0))
        end[idx] = b
    assert end == {i: len(t) for i, t in text.items()}
