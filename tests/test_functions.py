from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.functions.hashing import family_seed, lookup3, lookup3_column, minhash


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


def test_lookup3_published_vectors():
    assert lookup3("") == 0xDEADBEEF
    assert lookup3("Four score and seven years ago") == 0x17770551
    assert lookup3("Four score and seven years ago", 1) == 0xCD628161


def test_minhash_family():
    assert [family_seed(n, 42) for n in range(4)] == [2746317213, 165578901, 1969700810, 1636471393]
    assert [lookup3(w, family_seed(1, 42)) & 7 for w in "you have no faith in medicine".split()] == [0, 3, 7, 1, 6, 4]
    assert minhash([], 1, 7) is None
    assert all(minhash(["a", "b"], n, 7) == minhash(["b", "a", "a"], n, 7) for n in range(20))


@given(st.text(max_size=40), st.integers(0, 2**32 - 1))
@settings(max_examples=50, deadline=None)
def test_lookup3_is_32_bits(value, seed):
    assert 0 <= lookup3(value, seed) < 2**32


def test_lookup3_column(spark):
    got = spark.createDataFrame([("",), (None,), ("Four score and seven years ago",)], "c string").select(lookup3_column(F.col("c"), 0)).collect()
    assert [r[0] for r in got] == [0xDEADBEEF, None, 0x17770551]


@pytest.mark.parametrize(("value", "want"), [("Science -- Biology", "Biology"), ("Literature -- American", "Literature"), ("Unknown", "Unknown"), ("Non Selected", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("History", "History")])
def test_category(spark, value, want):
    assert one(spark, value, X.category) == want


def test_category_with_three_parts_raises(spark):
    with pytest.raises(Exception, match="more than two parts"):
        one(spark, "a--b--c", X.category)


@pytest.mark.parametrize(("value", "want"), [(" SCIENCE -- Math ", "math"), ("Fine Arts -- Music", "fine arts"), ("science", "science"), ("NON SELECTED", "unknown"), (" ", "unknown"), (None, "unknown"), ("Science --", "unknown")])
def test_reduced_category(spark, value, want):
    assert one(spark, value, X.reduced_category) == want


def test_text_columns(spark):
    assert one(spark, "For 10 points, for 10 points, for ten points", X.ftp_rewrite) == "FTP, FTP, for ten points"
    assert one(spark, "It’s_a TEST 42 ét", X.words) == ["it", "s", "a", "test", "42", "e", "t"]
    assert one(spark, None, X.words) is None
    assert one(spark, "", X.words) == []
    assert one(spark, "  Two Words\t", X.clean_feature) == "two words"
    assert one(spark, " \t", X.clean_feature) is None
    assert one(spark, "a b, c", X.ngrams) == ["a~b~,", "b~,~c"]
    assert one(spark, "a b", X.ngrams) == []
    assert one(spark, "Name Ada Byron of London. FTP", X.entities) == ["Name Ada Byron", "London"]
    assert one(spark, "this FTP old city", X.referer) == "old city"
    assert one(spark, "Don't stop!!", X.tokenized) == ["Don", "'", "t", "stop", "!!"]
