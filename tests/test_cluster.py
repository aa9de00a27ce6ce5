from __future__ import annotations

import random

import pytest

from quillmesh.operators import blocking, blocks, cluster, components, evaluate, linkage
from quillmesh.operators.components import connected
from quillmesh.session import Scratch

SIM = {(0, 1): 5.0, (0, 2): 3.0, (1, 2): 1.0, (0, 3): 0.5, (1, 3): 0.5, (2, 3): 2.5}


def groups(df, key="cluster"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["rec_id"])
    return sorted(map(sorted, out.values()))


def ids(spark, n):
    return spark.createDataFrame([(k,) for k in range(n)], "rec_id bigint")


def pairs(spark, sim):
    return spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a bigint, b bigint, s double")


@pytest.mark.parametrize(("linkage", "want"), [("min", [[0, 1], [2, 3]]), ("mean", [[0, 1], [2, 3]]), ("max", [[0, 1, 2, 3]])])
@pytest.mark.parametrize("small", [512, 1])
def test_linkages(spark, linkage, want, small):
    assert groups(cluster.agglomerate(ids(spark, 4), pairs(spark, SIM), 2.0, linkage, small=small).clusters) == want


def test_score_at_the_threshold_merges(spark):
    assert groups(cluster.agglomerate(ids(spark, 2), pairs(spark, {(0, 1): 2.0}), 2.0).clusters) == [[0, 1]]
    assert groups(cluster.agglomerate(ids(spark, 2), pairs(spark, {(0, 1): 2.0}), None).clusters) == [[0], [1]]
    with pytest.raises(ValueError):
        cluster.agglomerate(ids(spark, 2), pairs(spark, {}), 0.0)


def test_distances():
    x = dict(enumerate([1, 2, 10, 12, 13, 34]))
    d = {(a, b): abs(x[a] - x[b]) for a in x for b in x if a < b}
    one = [frozenset([k]) for k in x]
    assert len(cluster.agglomerate_local(one, d, None, "mean", distance=True)) == 1
    assert sorted(map(sorted, cluster.agglomerate_local(one, d, 5, "mean", distance=True))) == [[0, 1], [2, 3, 4], [5]]
    assert cluster.agglomerate_local(one, d, None, "mean") == one


@pytest.mark.parametrize("linkage", ["min", "mean", "max"])
def test_rounds_and_local_agree_with_one_by_one(spark, linkage):
    rnd = random.Random(3)
    sim = {(a, b): rnd.random() for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.5}
    want = sorted(map(sorted, cluster.agglomerate_local([frozenset([k]) for k in range(14)], sim, 0.4, linkage)))
    for small in (512, 1):
        assert groups(cluster.agglomerate(ids(spark, 14), pairs(spark, sim), 0.4, linkage, small=small).clusters) == want
    if linkage == "max":
        assert groups(cluster.single_link(ids(spark, 14), pairs(spark, sim), 0.4)) == want


@pytest.mark.parametrize("linkage", ["min", "mean"])
def test_ties_merge_alike_whatever_the_way(spark, linkage):
    rnd = random.Random(9)
    sim = {(a, b): float(rnd.randint(1, 3)) for a in range(12) for b in range(a + 1, 12) if rnd.random() < 0.7}
    want = sorted(map(sorted, cluster.agglomerate_local([frozenset([k]) for k in range(12)], sim, 1.5, linkage)))
    assert [groups(cluster.agglomerate(ids(spark, 12), pairs(spark, sim), 1.5, linkage, small=small).clusters) for small in (512, 1)] == [want, want]


def test_parts_of_the_scores(spark):
    rows = [(0, 1, 4.0, 1.0), (0, 2, 1.0, 2.0), (1, 2, 2.0, 0.5)]  # the first merge is 0 and 1, the second joins 2
    df = spark.createDataFrame([(a, b, t + n, t, n) for a, b, t, n in rows], "a bigint, b bigint, s double, tfidf double, named double")
    want = {"mean": {"tfidf": 4.0 + 1.5, "named": 1.0 + 1.25}, "max": {"tfidf": 5.0, "named": 3.0}, "min": {"tfidf": 6.0, "named": 1.5}}
    for linkage, parts in want.items():
        for small in (512, 1) if linkage != "min" else (512,):
            found = cluster.agglomerate(ids(spark, 3), df, 1.0, linkage, parts=("tfidf", "named"), small=small)
            assert [(r.feature, r.value) for r in found.informative(("tfidf", "named")).collect()] == sorted(parts.items(), key=lambda x: -x[1])
    none = cluster.agglomerate(ids(spark, 3), df, None, parts=("tfidf", "named"))
    assert {r.feature: r.value for r in none.informative(("tfidf", "named")).collect()} == {"tfidf": 0.0, "named": 0.0}


def test_informative_features_merge_over_the_sum(spark, tmp_path):
    from quillmesh.plans import catalog

    # each name is in two of three records, so its idf is 0: only the entities link, and 1 and 3 share nothing
    rows = [(1, "Ada. Ada. Ada."), (2, "Ada. Cy."), (3, "Cy.")]
    spark.createDataFrame(rows, "question_id bigint, body string").write.parquet(str(tmp_path / "questions.parquet"))
    got = [tuple(r) for r in catalog.informative_features(spark, str(tmp_path)).collect()]
    assert got == [("named", 3.5), ("referers", 1.0), ("category", 0.0), ("tfidf", 0.0)]


def test_trace(spark):
    gold = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y")], "rec_id bigint, label string")
    for small in (512, 1):
        found = cluster.agglomerate(ids(spark, 4), pairs(spark, SIM), 2.0, "mean", gold=gold, small=small)
        got = sorted((-r.threshold, r.precision, round(r.recall, 6), round(r.f1, 6)) for r in evaluate.merge_trace(found.merges, gold).collect())
        assert got == [(-5.0, 1.0, 0.333333, 0.5), (-2.5, 0.5, 0.333333, 0.4)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (None, 1), (9, 8), (8, 10), (10, 11), (11, 12)], "a bigint, b bigint")
    assert {r.rec_id: r.component for r in connected(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    assert connected(e.limit(0)).count() == 0


def vectors(spark, seed, n, terms=14):
    rnd = random.Random(seed)
    own = {k: {f"t{int(terms * rnd.random() ** 2)}": rnd.uniform(0.05, 0.8) for _ in range(rnd.randint(0, 6))} for k in range(n)}
    sim = {(a, b): sum(w * own[b][t] for t, w in own[a].items() if t in own[b]) for a in own for b in own if a < b}
    return own, {k: s for k, s in sim.items() if s}, spark.createDataFrame([(k, t, w) for k, x in own.items() for t, w in x.items()], "rec_id bigint, term string, w double")


def labels_of(n, edges):
    """The smallest id that each of n records is linked to."""
    label = list(range(n))
    while True:
        new = [min([label[k], *(label[a + b - k] for a, b in edges if k in (a, b))]) for k in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_components_over_terms(spark, least):
    n = 40
    own, sim, rows = vectors(spark, 4, n)
    part = {k: {k % 3, k % 5 + 10} for k in range(n)}
    within = spark.createDataFrame([(k, p) for k, ps in part.items() for p in ps], "rec_id bigint, part bigint")
    for met, given in ((lambda a, b: True, None), (lambda a, b: part[a] & part[b], within)):
        want = labels_of(n, [k for k, s in sim.items() if s >= least and met(*k)])
        got = {r.rec_id: r.cluster for r in cluster.single_link_terms(ids(spark, n), rows, least, given).collect()}
        assert got == dict(enumerate(want))


def test_links_by_several_terms_only(spark):
    # no term alone suffices for 1 and 2, nor for 2 and 3; 4 and 5 are linked by one, and not to the others
    rows = [(k, t, 0.4) for k, ts in {1: "abcd", 2: "abcdefgh", 3: "efgh"}.items() for t in ts] + [(4, "x", 0.9), (5, "x", 0.9), (3, "x", 0.1), (6, "a", 0.4)]
    df = spark.createDataFrame(rows, "rec_id bigint, term string, w double")
    assert {r.rec_id: r.component for r in components.over_terms(df, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert components.over_terms(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        components.over_terms(df, 0.0)


def test_canopies(spark):
    rnd = random.Random(5)
    n = 16
    s = {(x, y): rnd.random() for x in range(n) for y in range(n) if x != y and rnd.random() < 0.4}
    left, want = set(range(n)), set()
    while left:
        c = min(left)
        left.discard(c)
        near = {p for p in left if s.get((p, c), 0) > 0.2}
        want |= {(c, c)} | {(c, p) for p in near}
        left -= {p for p in near if s.get((p, c), 0) > 0.6}
    got = blocking.canopies(ids(spark, n), spark.createDataFrame([(*k, v) for k, v in s.items()], "x bigint, y bigint, score double"), 0.2, 0.6)
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        blocking.canopies(ids(spark, 2), got, 0.7, 0.6)


def test_canopies_in_batches(spark):
    from quillmesh.operators.index import Near

    n = 40
    own, _, rows = vectors(spark, 7, n)
    ones = {k: dict.fromkeys(x, 1.0) for k, x in own.items()}
    y = spark.createDataFrame([(k, t, w) for k, x in ones.items() for t, w in x.items()], "rec_id bigint, term string, w double")
    s = {(a, b): sum(w for t, w in own[a].items() if t in own[b]) for a in own for b in own if a != b}
    left, want = set(range(n)), set()
    while left:
        c = min(left)
        left.discard(c)
        near = {p for p in left if s[p, c] > 0.1}
        want |= {(c, c)} | {(c, p) for p in near}
        left -= {p for p in near if s[p, c] > 0.5}
    for batch in (5, 64):
        got = blocking.canopies_of(ids(spark, n), Near(rows, y), 0.1, 0.5, Scratch(spark), batch)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_canopy_clusters_keep_the_invariant(spark):
    sim = {(a, b): 1.0 for a in range(36) for b in range(a + 1, 36) if a % 12 == b % 12}
    canopy = spark.createDataFrame([(c, r) for c in range(6) for r in range(36) if r % 6 == c or r % 3 == c], "center bigint, rec_id bigint")
    for linkage in ("max", "min"):
        assert groups(blocking.canopy_clusters(canopy, pairs(spark, sim), 0.5, linkage)) == [[k, k + 12, k + 24] for k in range(12)]


def test_iterative_blocking(spark):
    sim = {(a, b): 1.0 for a in range(48) for b in range(a + 1, 48) if a % 12 == b % 12}
    rows = [(c, str(r % m), r) for c, m in enumerate((2, 3, 4)) for r in range(48)]
    got = blocking.iterative_blocking(ids(spark, 49), spark.createDataFrame(rows, "criterion int, key string, rec_id bigint"), pairs(spark, sim), 0.5)
    assert groups(got) == sorted([[k, k + 12, k + 24, k + 36] for k in range(12)] + [[48]])
    block = {}
    for k, (c, key, r) in enumerate(rows):
        block.setdefault((c, key), []).append(r)
    local = blocking.iterative_blocks(dict(enumerate(block.values())), sim, list(range(48)), 0.5, "mean")
    assert all((local[a] == local[b]) == (a % 12 == b % 12) for a in range(48) for b in range(48))


def test_iterative_blocking_over_terms(spark):
    n = 24
    _, sim, rows = vectors(spark, 11, n, 20)
    met = [(c, str(r * 7 % (c + 4)), r) for c in range(2) for r in range(n - 1)]
    block = spark.createDataFrame(met, "criterion int, key string, rec_id bigint")
    own = {}
    for c, key, r in met:
        own.setdefault(r, set()).add((c, key))
    label, changed = list(range(n)), True
    while changed:
        of = {x: set().union(*(own.get(k, set()) for k in range(n) if label[k] == x)) for x in label}
        pair = next(((label[a], label[b]) for (a, b), s in sim.items() if s >= 0.4 and label[a] != label[b] and of[label[a]] & of[label[b]]), None)
        changed = pair is not None
        if changed:
            label = [min(pair) if x in pair else x for x in label]
    got = {r.rec_id: r.cluster for r in blocking.iterative_blocking_terms(ids(spark, n), block, rows, 0.4).collect()}
    assert got == dict(enumerate(label))
    assert 1 < len(set(label)) < n


def test_minhash_blocks(spark):
    p = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "a", 1), (3, "c", 1)], "rec_id bigint, term string, cnt int")
    keys = {r.rec_id: r.key for r in blocking.minhash_keys(p, 1, 0b111).collect()}
    assert keys[1] == keys[2]
    cats = spark.createDataFrame([(k, "x") for k in (1, 2, 3, 4)], "rec_id bigint, category string")
    got = blocking.blocks(p, cats, hashed=blocking.md5_hash).collect()
    assert {r.rec_id for r in got} == {1, 2, 3}  # a record without phrases is in no block
    assert len({(r.key, r.rec_id) for r in got if r.criterion > 0}) == 3  # all use one hash
    assert {r.criterion for r in blocking.blocks(p, cats, hashed=blocking.md5_hash, semantics="corrected").collect()} == {0, 1, 2, 3}


def test_thresholds():
    assert blocking.tight_threshold("INVERSE", 4) == 0.25
    assert blocking.tight_threshold("INVERSESQRT", 4) == 0.5
    assert blocking.tight_threshold("INVERSELOG", 1) == float("inf")


def test_evaluation(spark):
    e = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "rec_id bigint, cluster bigint")
    g = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y")], "rec_id bigint, label string")
    r = evaluate.Contingency(e, g).report().first()
    assert (r.precision, round(r.recall, 9), round(r.f1, 9), r.cluster_f1) == (0.5, round(1 / 3, 9), 0.4, 0.0)
    assert abs(r.vi - 0.8239592165010822) < 1e-12
    same = evaluate.Contingency(g.select("rec_id", g.label.alias("cluster")), g).report().first()
    assert (same.f1, same.cluster_f1, same.vi) == (1.0, 1.0, 0.0)
    none = evaluate.Contingency(e.limit(0), g).report().first()
    assert (none.f1, none.cluster_f1, none.vi) == (0.0, 0.0, 0.0)


def test_precision_recall(spark):
    g = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y")], "rec_id bigint, label string")
    got = sorted(((r.a, r.b), r.precision, round(r.recall, 6)) for r in evaluate.precision_recall(pairs(spark, SIM), g).collect())
    order = sorted(SIM, key=lambda k: (-SIM[k], k))
    hits, want = 0, []
    for n, (a, b) in enumerate(order, 1):
        hits += b < 3
        want.append(((a, b), hits / n, round(hits / 3, 6)))
    assert got == sorted(want)


def test_merged_clusterings(spark):
    from quillmesh.operators.components import merged

    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "rec_id bigint, cluster bigint")
    b = spark.createDataFrame([(2, 2), (3, 2), (4, 4), (5, 4)], "rec_id bigint, cluster bigint")
    assert groups(merged(a, b)) == [[1, 2, 3], [4, 5]]


def vectors(n, seed=5):
    """Weights of twelve terms, and the products of any two records."""
    rnd = random.Random(seed)
    w = {r: {t: rnd.randint(1, 9) / 8 for t in range(12) if rnd.random() < 0.3} for r in range(n)}
    sim = {(a, b): sum(u * w[b][t] for t, u in w[a].items() if t in w[b]) for a in range(n) for b in range(a + 1, n)}
    return [(r, f"t{t}", u) for r, x in w.items() for t, u in x.items()], {k: s for k, s in sim.items() if s}


def test_pairs_above_a_sum_come_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 9)
    monkeypatch.setattr(blocks, "PART", 0.2)  # some terms dense, some not
    data, sim = vectors(40)
    rows = spark.createDataFrame([(r, int(t[1:]), u) for r, t, u in data], "rec_id bigint, term bigint, w double")
    found = lambda *of: sorted((x["a"], x["b"], round(x["s"], 9)) for x in blocks.above(rows, 0.7, *of).collect())
    want = sorted((a, b, round(s, 9)) for (a, b), s in sim.items() if s >= 0.7)
    assert want and found() == want
    some = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "rec_id bigint")
    assert found(some) == [x for x in want if x[0] % 3 == 0 or x[1] % 3 == 0]


@pytest.mark.parametrize("kind", ["min", "mean"])
def test_linkage_over_terms_agrees_with_one_by_one(spark, kind):
    data, sim = vectors(24)
    gold = spark.createDataFrame([(k, str(k % 3)) for k in range(20)], "rec_id bigint, label string")
    rows = spark.createDataFrame(data, "rec_id bigint, term string, w double")
    want = sorted(map(sorted, cluster.agglomerate_local([frozenset([k]) for k in range(26)], sim, 0.7, kind)))
    assert 5 < len(want) < 22
    plain = cluster.agglomerate(ids(spark, 26), pairs(spark, sim), 0.7, kind, gold=gold)
    shape = lambda x: [sorted(round(r["score"], 9) for r in x), sum(r["pairs"] for r in x), sum(r["hits"] for r in x)]
    for left in (10**6, 4):  # at once, and in rounds over all tasks
        found = linkage.agglomerate_terms(ids(spark, 26), rows, 0.7, kind, gold=gold, left=left)
        assert groups(found.clusters) == want
        assert shape(found.merges.collect()) == shape(plain.merges.collect())


def without_pairs(spark, monkeypatch, name):
    """A query of the catalogue where joining all postings is an error."""
    from quillmesh.operators import index
    from quillmesh.plans import catalog

    def joined(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(index, "dot", joined)
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_complete_link_clusters_make_no_pairs_below_the_threshold(spark, monkeypatch):
    assert without_pairs(spark, monkeypatch, "complete_link_clusters") > 0


def test_mean_link_clusters_make_no_pairs_below_the_threshold(spark, monkeypatch):
    assert without_pairs(spark, monkeypatch, "mean_link_clusters") > 0


def test_merge_trace_makes_no_pairs_below_the_threshold(spark, monkeypatch):
    assert without_pairs(spark, monkeypatch, "merge_trace") > 0
