import re

import pytest

from corpusloom.llm import queries
from tests import oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, con, name):
    oracle.check(con, queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_a_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    got = queries.queries()[name](spark, DATA)
    assert got.select("doc_id").exceptAll(docs).count() == 0 and docs.exceptAll(got.select("doc_id")).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
