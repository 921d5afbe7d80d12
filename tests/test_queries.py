"""Every registered retrieval query against its SQL, and those without SQL against plain versions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, same, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)


def test_every_key_of_the_sql_is_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_eight_hits(spark):
    assert __spark_entry__.entry(spark).count() == 8


def test_all_references_are_the_pages_own(spark):
    rows = QUERIES["extract_all_citations"](spark, SF).collect()
    assert rows and all(r.kind in ("url", "iso", "law", "internal_ref") for r in rows)


def test_backfill_gives_every_document_a_vector(spark):
    rows = QUERIES["embedding_backfill"](spark, SF).collect()
    assert len(rows) == 200 and all(r.dim == 64 for r in rows)


def test_the_flagship_searches_all_documents(spark):
    """No condition on currency, in the SQL or in the code."""
    assert "doc_id % 7" not in SQL["hybrid_search"]
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert rows("hybrid_search") == rows("hybrid_archived")
