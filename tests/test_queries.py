import pytest

from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES
from tests import oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    oracle.check(con, QUERIES[name](spark, DATA), ORACLES[name])


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_figures_of_whole_texts(spark, tmp_path):
    docs = [(1, "x" * 400 + " [Figure: late.png]", "web"), (2, None, "web"), (3, "[Figure: a] [Figure: " + "b" * 60 + "]", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.figures for r in QUERIES["figure_refs"](spark, str(tmp_path)).collect()}
    assert got == {1: "img_1.png,web,late.png", 2: "img_2.png,web", 3: "img_3.png,web,a," + "b" * 60}
