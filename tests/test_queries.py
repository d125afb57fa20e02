import os

import pytest

from guideloom import pipeline_queries, search_queries
from tests.conftest import TABLES, against_sql

QUERIES = pipeline_queries.QUERIES | search_queries.QUERIES
SQL = pipeline_queries.SQL | search_queries.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    against_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_genome_search_takes_every_spacer_location(spark):
    found = search_queries.genome_search(spark, TABLES).select("query_name").distinct()
    located = search_queries.site_sequences(spark, TABLES).where("length(seq) = 20").selectExpr("string(site_id) AS query_name")
    missed = located.join(found, "query_name", "left_anti")
    # A location that no hit names holds no site beside a PAM, or one over the threshold of dust: few do.
    assert found.where("query_name % 20 <> 0").count() > 0 and missed.count() < 0.1 * located.count()
