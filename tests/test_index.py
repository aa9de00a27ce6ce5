from __future__ import annotations

import math
import random

import pytest

from quillmesh.config import Options
from quillmesh.operators import blocks, index, pairs, similarity

DOCS = {0: "colorless green ideas sleep furiously", 1: "jolly jolly green giant", 2: "jolly roger himself", 3: "drove my chevy to the levee", 4: "but the levee was dry"}


@pytest.fixture
def built(spark):
    return index.Index(spark.createDataFrame([(k, w) for k, t in DOCS.items() for w in t.split()], "rec_id bigint, term string"), start=0)


def test_frequencies(built):
    tf = {(r.rec_id, r.term): r.tf for r in built.tf.collect()}
    assert tf[0, "green"] == 0.2
    assert tf[1, "jolly"] == 0.5
    df = {r.term: r.df for r in built.df.collect()}
    assert (df["jolly"], df["chevy"], df["green"], df.get("brownstone", 0)) == (2, 1, 2, 0)


def test_scores(built):
    got = {(r.x, r.y): r.score for r in built.scores().collect()}
    want = {(0, 1): 0.027725887222397817, (1, 0): 0.04332169878499658, (1, 2): 0.17328679513998632, (2, 1): 0.07701635339554948, (3, 4): 0.03850817669777474, (4, 3): 0.05545177444479563}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_weight_of_a_term_in_most_documents(spark):
    rows = spark.createDataFrame([(k, w) for k in range(3) for w in ("all", f"own{k}")], "rec_id bigint, term string")
    assert {r.term: r.idf for r in index.Index(rows).df.collect()}["all"] == 0.0
    exact = {r.term: r.idf for r in index.Index(rows, semantics="corrected").df.collect()}
    assert math.isclose(exact["own1"], math.log(3))


def test_empty(spark):
    empty = index.Index(spark.createDataFrame([], "rec_id bigint, term string"))
    assert empty.scores().count() == 0
    assert empty.dot().count() == 0


def test_dot_and_total(spark):
    a = spark.createDataFrame([(1, 2, 0.5)], "a bigint, b bigint, tfidf double")
    n = spark.createDataFrame([(1, 3, 4)], "a bigint, b bigint, named bigint")
    got = {(r.a, r.b): r.total for r in similarity.total(a, n).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 4.5}
    cats = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "rec_id bigint, category string")
    o = Options(category_weight=2.0, semantics="corrected")
    assert {(r.a, r.b): r.category for r in similarity.total(a, n, o, categories=cats).collect()} == {(1, 2): 2.0, (1, 3): 0.0}
    assert all(r.category == 2.0 for r in similarity.total(a, n, Options(category_weight=2.0)).collect())


def test_entities(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, ["Ada", "Ada", "FTP", ""]), (2, ["Ada"]), (3, []), (None, ["Ada"])], "id bigint, p array<string>")
    c = similarity.entity_counts(df, "id", F.col("p"))
    assert sorted(tuple(r) for r in c.collect()) == [(1, "Ada", 2), (2, "Ada", 1)]
    assert similarity.expanded(c).count() == 3
    assert [tuple(r) for r in similarity.entity_similarity(c).collect()] == [(1, 2, 2)]


def test_taxonomy(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    ref = spark.createDataFrame([(1, "dog"), (2, "cat")], "rec_id bigint, lemma string")
    lem = spark.createDataFrame([("dog", "d"), ("cat", "c")], "lemma string, synset string")
    anc = spark.createDataFrame([("d", "d", 3.0), ("c", "c", 2.0), ("d", "animal", 1.0), ("c", "animal", 1.0), ("d", "thing", 0.0), ("c", "thing", 0.0)], "synset string, ancestor string, ic double")
    got = {(r.a, r.b): r.referers for r in similarity.referer_similarity(pairs, ref, lem, anc).collect()}
    assert math.isclose(got[1, 2], 1 / (1 + math.exp(-1 / 3)))
    assert got[1, 3] == 0.5


def test_options():
    assert Options(algorithm="maxcluster").linkage == "max"
    with pytest.raises(ValueError, match="MEANCLUSTER"):
        Options(algorithm="other")
    assert Options().relevant() == [("Threshold", 2.0), ("Limit", -1)]


@pytest.mark.parametrize("least", [0.05, 0.3, 1.0])
def test_pairs_at_least(spark, least):
    rnd = random.Random(4)
    own = {k: {f"t{int(12 * rnd.random() ** 2)}": rnd.uniform(0.05, 0.8) for _ in range(rnd.randint(0, 6))} for k in range(40)}
    other = {k: {t: rnd.uniform(0.1, 1.0) for t in terms} for k, terms in own.items()}
    x, y = (spark.createDataFrame([(k, t, w) for k, terms in side.items() for t, w in terms.items()], "rec_id bigint, term string, w double") for side in (own, other))
    got = {(r.x, r.y): r.s for r in index.at_least(x, y, least).collect()}
    every = {(a, b): sum(w * other[b][t] for t, w in own[a].items() if t in other[b]) for a in own for b in own if a != b}
    assert got.keys() == {k for k, s in every.items() if s >= least}
    assert all(math.isclose(s, every[k]) for k, s in got.items())
    some = spark.createDataFrame([(k,) for k in range(5)], "rec_id bigint")
    to = {(r.x, r.y): r.score for r in index.Near(x, y).to(some).collect()}
    assert to.keys() == {k for k, s in every.items() if s and k[1] < 5}
    assert index.at_least(x.limit(0), y, least).count() == 0
    with pytest.raises(ValueError):
        index.at_least(x, y, 0.0)


def test_linked_pairs_are_those_of_the_dot_product(built):
    every = {(r.a, r.b): r.tfidf for r in built.dot().collect()}
    got = {(r.a, r.b): r.s for r in built.linked(0.1).collect()}
    assert got.keys() == {k for k, s in every.items() if s >= 0.1}


def test_lookups_numbers_and_filters(spark, built):
    asked = spark.createDataFrame([(1, "JOLLY"), (0, "jolly"), (1, "brownstone"), (99, "green")], "rec_id bigint, term string")
    got = {(r.rec_id, r.term): (r.tf, r.idf > 0) for r in built.lookup(asked).collect()}
    assert got == {(1, "jolly"): (0.5, True), (0, "jolly"): (0.0, True), (1, "brownstone"): (0.0, False), (99, "green"): (0.0, True)}
    terms = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("",)], "term string")
    assert sorted(map(tuple, index.numbered(terms).collect())) == [("", 0), ("a", 1), ("b", 2)]
    rows = spark.createDataFrame([(1, w) for w in ("The", "whose", "ox", "levee")], "rec_id bigint, term string")
    assert [r.term for r in index.Index(rows, keep=index.telling()).df.collect()] == ["levee"]


def test_pairs_that_share_a_term_come_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 9)
    monkeypatch.setattr(blocks, "PART", 0.2)  # some terms dense, some not
    rnd = random.Random(7)
    own, more = ({3 * k: {f"t{int(20 * rnd.random() ** 2)}": rnd.randint(1, 8) / 8 for _ in range(rnd.randint(0, 4))} for k in range(40)} for _ in range(2))
    x, y = (spark.createDataFrame([(k, t, w) for k, terms in side.items() for t, w in terms.items()], "rec_id bigint, term string, w double") for side in (own, more))
    dot = lambda of: {(a, b): sum(w * of[b][t] for t, w in of[a].items() if t in of[b]) for a in of for b in of if a < b and of[a].keys() & of[b].keys()}
    assert {(r.a, r.b): r.s for r in pairs.sums({"s": x}).collect()} == dot(own)
    one, two = dot(own), dot(more)
    got = [tuple(r) for r in pairs.sums({"u": x, "v": y}).collect()]
    assert sorted(got) == sorted((*k, one.get(k, 0.0), two.get(k, 0.0)) for k in one.keys() | two.keys())
    assert 0 < len(one) < 40 * 39 / 2
    to = {(r.x, r.y): r.score for r in pairs.directed(x).collect()}
    assert to == {(a, b): sum(w for t, w in own[a].items() if t in own[b]) for a in own for b in own if a != b and own[a].keys() & own[b].keys()}


def by_blocks(spark, monkeypatch, name):
    """Rows of a query of the catalogue where joining postings, or rows for single products, is an error."""
    from quillmesh.plans import catalog

    def joined(*_):
        raise AssertionError("postings are joined")

    monkeypatch.setattr(index, "dot", joined)
    monkeypatch.setattr(similarity, "dot", joined, raising=False)
    monkeypatch.setattr(index.Near, "to", joined)
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_tfidf_pair_similarity_comes_block_by_block(spark, monkeypatch):
    assert by_blocks(spark, monkeypatch, "tfidf_pair_similarity") > 0


def test_doc_scores_comes_block_by_block(spark, monkeypatch):
    assert by_blocks(spark, monkeypatch, "doc_scores") > 0


def test_entity_scores_comes_block_by_block(spark, monkeypatch):
    assert by_blocks(spark, monkeypatch, "entity_scores") > 0


def test_entity_similarity_comes_block_by_block(spark, monkeypatch):
    assert by_blocks(spark, monkeypatch, "entity_similarity") > 0


def test_pair_similarity_total_comes_block_by_block(spark, monkeypatch):
    assert by_blocks(spark, monkeypatch, "pair_similarity_total") > 0


def test_pr_curve_makes_and_sorts_no_rows_for_pairs(spark, monkeypatch):
    from quillmesh.operators import evaluate

    monkeypatch.setattr(evaluate, "precision_recall", None)
    assert by_blocks(spark, monkeypatch, "pr_curve") > 0


@pytest.mark.parametrize("labels", [3, 40])
def test_curve_over_terms_agrees_with_the_one_over_pairs(spark, monkeypatch, labels):
    from quillmesh.operators import curve, evaluate

    monkeypatch.setattr(curve, "STRIP", 3)
    monkeypatch.setattr(curve, "STRIPS", 2)
    monkeypatch.setattr(curve, "BATCH", 7)
    rnd = random.Random(3)
    data = [(5 * k, f"t{t}", rnd.randint(1, 4) / 4) for k in range(40) for t in range(9) if rnd.random() < 0.25]
    rows = spark.createDataFrame(data, "rec_id bigint, term string, w double")
    gold = spark.createDataFrame([(5 * k, k % labels) for k in range(36)], "rec_id bigint, label bigint")
    plain = lambda df: {(r.a, r.b): tuple(r[2:]) for r in df.collect()}
    got, want = plain(curve.precision_recall(rows, gold)), plain(evaluate.precision_recall(pairs.sums({"s": rows}), gold))
    assert len(want) > 200 and got.keys() == want.keys()
    assert all(math.isclose(x, y, abs_tol=1e-6) for k in want for x, y in zip(got[k], want[k], strict=True))
