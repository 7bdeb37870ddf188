import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text


def one(spark, make, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(make(*map(F.col, values)).alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [("DB-117 x.accdb v7.4.2", ["db-117", "x.accdb", "v7.4.2"]), ("a--b -c d. é1", ["a", "b", "c", "d", "1"]), ("", []), (None, [])])
def test_tokens(spark, value, want):
    assert one(spark, text.tokens, t=value) == want


@pytest.mark.parametrize("value, want", [(" \t a b\n", "a b"), ("  ", "New Conversation"), (None, "New Conversation"), (" x ", "x")])
def test_title(spark, value, want):
    assert one(spark, text.title, t=value) == want


def test_title_of_question_is_cut_first(spark):
    assert one(spark, text.title_of_question, t=" " * 99 + "ab") == "a"


@pytest.mark.parametrize("rewritten, want", [("r", "r"), ("", "q"), (None, "q")])
def test_standalone_query(spark, rewritten, want):
    assert one(spark, text.standalone_query, r=rewritten, q="q") == want


def test_small_functions(spark):
    assert one(spark, text.figure_refs, t="[Figure: a.png] x [Figure: b c] [Figure: ]") == ["a.png", "b c"]
    assert one(spark, text.chunk_id, d="d", i="3") == "d:3"
    assert one(spark, text.suffix, p="word/media/a.PNG") == ".png"
    assert one(spark, text.suffix, p="word/media.d/abc") == ".bin"
    assert one(spark, text.basename, p="/x/y.md") == "y.md"
    assert spark.range(1).select(text.seconds(F.lit(2.125))).first()[0] == 2.12


def test_cosine(spark):
    row = spark.range(1).select(text.cosine_unit(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.0))).alias("x")).first()
    assert row["x"] == pytest.approx(0.6)


def test_split_by_hand():
    assert text.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert text.split_text("aaa\n\nbbb ccc", 9, 0) == ["aaa", "bbb ccc"]
    assert text.split_text("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert text.split_text("one\ntwo\n\nthree", 100, 10) == ["one\ntwo\n\nthree"]
    assert text.split_text(None) == text.split_text("") == text.split_text(" \n ") == []


@pytest.mark.parametrize("seed", range(8))
def test_split_invariants(seed):
    rng = random.Random(seed)
    whole = "".join(rng.choice([f"word{i} ", f"{i}x" * rng.randint(1, 12), " ", "\n", "\n\n", f"é{i}"]) for i in range(400))
    cut = text.split_text(whole, 100, 30)
    assert all(0 < len(c) <= 100 and c == c.strip() and c in whole for c in cut)
    at = 0
    for c in cut:  # in order, and nothing but white space is left out
        found = whole.find(c, max(0, at - 100))
        assert found >= 0 and not whole[at:found].strip()
        at = max(at, found + len(c))
    assert not whole[at:].strip()
