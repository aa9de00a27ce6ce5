from __future__ import annotations

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import components, markov, neardup, overlap, setjoin, terms
from quillmesh.session import Scratch


def closed(pairs, least=2):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    groups = {}
    for x in list(top):
        groups.setdefault(find(x), set()).add(x)
    return {(k, x) for k, g in groups.items() if len(g) >= least for x in g}


# ---------------------------------------------------------------- problem 2


def test_contraction(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    rnd.shuffle(edges)
    dirt = [(None, 5), (5, None), (None, None), (999, 999), *edges[:10], *((b, a) for a, b in edges[:10])]
    df = spark.createDataFrame([(a, b, 0) for a, b in edges + dirt], "l bigint, r bigint, a int")
    got = [tuple(r) for r in components.contract(df, "l", "r").collect()]
    assert len(got) == len(set(got))
    assert set(got) == closed((a, b) for a, b in edges if a != b)
    assert components.contract(df.where("l = 999"), "l", "r").count() == 0


# ---------------------------------------------------------------- problems 4 and 6

ROWS = [(1, 1, "A"), (1, 1, " a "), (1, 2, "a"), (1, 3, "b"), (1, 4, ""), (1, 5, None), (2, 1, "a"), (2, 2, "c"), (2, 3, "c"), (2, None, "c"), (2, None, "c"), (3, 1, "a"), (3, 2, "c"), (4, 1, "a"), (4, 2, "d"), (None, 1, "z"), (5, 1, " ")]


@pytest.fixture
def tokens(spark):
    return spark.createDataFrame(ROWS, "q bigint, o int, f string").withColumn("n", F.lit("clash")).withColumn("term", F.lit("clash"))


def test_frequencies(tokens):
    got = {r.term: (r.n_rows, r.n_records, r.mark) for r in terms.term_frequencies(tokens, "q", "o", "f", least=2, share=0.5).collect()}
    assert got == {"a": (5, 4, "common"), "b": (1, 1, "rare"), "c": (4, 2, None), "d": (1, 1, "rare")}
    assert terms.term_frequencies(tokens.limit(0), "q", "o", "f").count() == 0


def test_distinctiveness(tokens):
    got = {(r.rec, r.term): r for r in terms.distinctiveness(tokens, "q", "o", "f", prior=10.0).collect()}
    counts = {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (2, "c"): 3, (3, "a"): 1, (3, "c"): 1, (4, "a"): 1, (4, "d"): 1}
    assert {k: r.n for k, r in got.items()} == counts
    total, own = Counter(), Counter()
    for (q, f), n in counts.items():
        total[f] += n
        own[q] += n
    whole = sum(own.values())
    for (q, f), n in counts.items():
        prior = 10.0 * total[f] / whole
        a, b = n + prior, total[f] - n + prior
        z = (math.log(a / (own[q] + 10 - a)) - math.log(b / (whole - own[q] + 10 - b))) / math.sqrt(1 / a + 1 / b)
        assert math.isclose(got[q, f].z, z)
        assert math.isclose(got[q, f].tfidf, n / own[q] * math.log(4 / sum((x, f) in counts for x in own)))
    assert [tuple(r) for r in terms.standing_out(terms.distinctiveness(tokens, "q", "o", "f")).collect()] == [(2, "c"), (3, "c")]


def test_only_overrepresented_terms_stand_out(tokens):
    scored = terms.distinctiveness(tokens, "q", "o", "f", prior=10.0)
    whole = scored.groupBy("term").agg(F.sum("n").alias("n_rows"))
    total = scored.agg(F.sum("n")).first()[0]
    rows = scored.join(whole, "term").where("z is not null").collect()
    assert len(rows) == 8
    assert all((r.z > 1e-12) == (r.n / r.n_rec_rows > r.n_rows / total + 1e-12) for r in rows)
    assert terms.standing_out(scored.withColumn("z", -F.col("z"))).count() == 0


# ---------------------------------------------------------------- problems 3, 5 and 7


def texts(n, seed, vocab=400, short=4, moved=0.1):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out)[1].split()
            for _ in range(rnd.randint(0, 9)):
                p = rnd.randrange(len(w))
                w[p : p + 1] = rnd.choice(([], [f"v{rnd.randrange(vocab)}"], [w[p], f"v{rnd.randrange(vocab)}"]))
            if rnd.random() < moved:
                rnd.shuffle(w)
        else:
            w = [f"v{int(vocab * rnd.random() ** 2)}" for _ in range(rnd.randint(short, short + 36))]
        out.append((k, " ".join(w)))
    return out


def near(sets, num, den, least):
    ok = [(k, s) for k, s in sets if len(s) >= least]
    return {(a, b) for a, s in ok for b, t in ok if a < b and len(s & t) * den >= num * len(s | t)}


@pytest.mark.parametrize(("num", "den", "hot", "planes", "heavy"), [(7, 10, setjoin.HOT, 128, 1 << 20), (7, 10, 3, 64, 1 << 20), (3, 10, 5, 128, 10)])
def test_similar_sets_lose_nothing(spark, monkeypatch, num, den, hot, planes, heavy):
    monkeypatch.setattr(setjoin, "MOST_HEAVY", heavy)  # 10: too many frequent tokens for a broadcast
    least = 10 if num == 7 else 1
    data = texts(160, 7) + [(200 + k, w) for k, w in enumerate(["v0", "v1", "v0 v1", "v0 v1 v2", "v0 v2", "v0 v3 v4"])]
    df = spark.createDataFrame(data + data[:20] + [(900, None), (901, ""), (None, "x y")], "id bigint, t string").withColumn("tokens", F.lit(1))
    s = setjoin.SimilarSets(neardup.word_sets(df, "id", df["t"], least), num, den, Scratch(spark), planes, hot)
    want = near([(k, set(t.split())) for k, t in data], num, den, least)
    cid = dict(s.members.select("id", "cid").collect())
    got = {(r.a, r.b) for r in s.pairs.collect()}
    assert got == {(min(cid[a], cid[b]), max(cid[a], cid[b])) for a, b in want if cid[a] != cid[b]}
    assert all(cid[a] == cid[b] or (min(cid[a], cid[b]), max(cid[a], cid[b])) in got for a, b in want)


def test_hot_keys_are_cut(spark, monkeypatch):
    rows = spark.createDataFrame([(1, True, k) for k in range(1000)] + [(2, True, k) for k in range(5)] + [(3, False, k) for k in range(300)], "key bigint, hot boolean, cid bigint")
    often = spark.createDataFrame([(1, 1000)], "key bigint, count bigint")
    for most in (1 << 20, 0):  # as a broadcast, or joined
        monkeypatch.setattr(setjoin, "MOST_HEAVY", most)
        blocks = {}
        for r in setjoin.in_chunks(rows, often, "cid", 100, Scratch(spark)).collect():
            blocks.setdefault((r.hot, r.key), set()).add(r.cid)
        assert blocks[True, 2] == set(range(5))
        assert blocks[False, 3] == set(range(300))
        hot = [b for (h, k), b in blocks.items() if h and k != 2]
        assert max(map(len, hot)) < 400
        met = {(a, b) for x in hot for a in x for b in x if a < b}
        assert len(met) == 1000 * 999 // 2


def test_hot_pairs():
    flat, row = np.array([5, 6, 7, 8, 9, 10]), np.array([0, 0, 0, 1, 2, 2])
    key, at = setjoin.hot_pairs(flat, row, np.array([True, False, True, True, True, True]), 3)
    assert at.tolist() == [0, 2]
    assert len(set(key.tolist())) == 2


def test_sliced_comparison():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(5, 60, 300))
    group = np.repeat([3, 5, 9], [130, 1, 169])
    n = np.concatenate([np.sort(n[group == g]) for g in (3, 5, 9)])
    sk = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    sk[150:200] = sk[100:150] = sk[:50]
    sk[100:150, 0] ^= np.uint64(0b1011)
    apart = np.bitwise_count(sk[:, None] ^ sk[None]).sum(axis=2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and apart[a, b] * 17 <= 3 * (n[a] + n[b]) and max(n[a], n[b]) * 7 <= min(n[a], n[b]) * 10}
    for compare in (setjoin.sliced_pairs, setjoin.near_pairs):
        i, j = compare(group, n, sk, 7, 10)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    group = np.sort(rng.integers(0, 40, 300))  # few in a group
    n = np.concatenate([np.sort(n[group == g]) for g in np.unique(group)])
    i, j = setjoin.near_pairs(group, n, sk, 7, 10)
    x, y = setjoin.sliced_pairs(group, n, sk, 7, 10)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


def test_near_copy_groups(spark):
    data = texts(120, 11)
    df = spark.createDataFrame(data, "id bigint, t string")
    got = {tuple(r) for r in neardup.near_copy_groups(df, "id", df["t"]).collect()}
    assert got == closed(near([(k, set(t.split())) for k, t in data], 7, 10, 10))
    assert neardup.near_copy_groups(df.limit(0), "id", df["t"]).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a b")], "id bigint, t string")
    assert {tuple(r) for r in neardup.near_copy_groups(df, "id", df["t"]).collect()} == {(1, 1), (1, 2)}


@pytest.mark.parametrize(("num", "planes", "sizes"), [(7, 128, range(700, 1001, 50)), (3, 256, range(480, 561, 20))])
def test_long_near_copies(spark, num, planes, sizes):
    data = []
    for k, n in enumerate(sizes):
        w = [f"t{k}w{x}" for x in range(n)]
        data += [(2 * k, w), (2 * k + 1, w[n // 20 :] + [f"t{k}new{x}" for x in range(n // 20)])]
    short = [f"t0w{x}" for x in range(200)]
    data += [(100, short), (101, [*short[10:], "other"])]  # in a block with long ones
    df = spark.createDataFrame(data, "id bigint, words array<string>").select("id", F.expr("transform(words, w -> xxhash64(w))").alias("tokens"))
    got = {(r.a, r.b) for r in setjoin.SimilarSets(df, num, 10, Scratch(spark), planes).pairs.collect()}
    assert got == near([(k, set(w)) for k, w in data], num, 10, 10)


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    flat, n = rng.integers(0, 50, 200), np.array([3, 0, 7, 90, 100])
    text, pos, fp = overlap.winnow(flat, n, 5, 4)
    assert set(text.tolist()) == {2, 3, 4}
    for t in (2, 3, 4):
        p = sorted(pos[text == t].tolist())
        assert all(any(a <= x < a + 4 for x in p) for a in range(max(1, n[t] - 4 - 3)))
    same = {(overlap.winnow(flat[100:200], np.array([100]))[2]).tobytes(), fp[text == 4].tobytes()}
    assert len(same) == 1


def test_chain():
    a = np.arange(30)
    b = np.r_[90, 91, a[3:20], 95, a[21:30], a[:2]]
    seeds = overlap.shared_seeds([a, a], [b, a + 100])
    assert overlap.chain(a, b, seeds[0]) == [(3, 2, 17), (21, 20, 9)]
    assert overlap.chain(a, a + 100, seeds[1]) == []
    assert set(seeds[0]) <= {(p, q) for p in range(26) for q in range(26) if (a[p : p + 5] == b[q : q + 5]).all()}
    same = overlap.shared_seeds([a], [a])[0]
    assert overlap.chain(a, a, same) == [(0, 0, 30)]


def test_runs_are_equal_words_and_dont_meet():
    rnd = random.Random(6)
    for _ in range(60):
        a = np.array([rnd.randrange(40) for _ in range(rnd.randint(0, 80))], np.int64)
        b = a.tolist()
        for _ in range(rnd.randint(0, 6)):
            p = rnd.randrange(len(b) + 1)
            b[p : p + rnd.randint(0, 4)] = [rnd.randrange(40) for _ in range(rnd.randint(0, 3))]
        b = np.array(b, np.int64)
        runs = overlap.chain(a, b, overlap.shared_seeds([a], [b])[0])
        assert all((a[p : p + k] == b[q : q + k]).all() and k > 0 for p, q, k in runs)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(runs, runs[1:]))


@pytest.mark.parametrize(("hot", "short", "moved", "heavy"), [(setjoin.HOT, 24, 0.0, 1 << 20), (3, 24, 0.0, 10), (setjoin.HOT, 4, 0.3, 1 << 20), (3, 4, 0.3, 1 << 20)])
def test_cross_split(spark, monkeypatch, hot, short, moved, heavy):
    monkeypatch.setattr(setjoin, "MOST_HEAVY", heavy)
    data = texts(140, 13, short=short, moved=moved)
    if moved:  # short texts, a third of them shuffled
        data = [(k, " ".join(t.split()[: 12 + k % 12])) for k, t in data]
    rnd = random.Random(5)
    flags = [(k, rnd.random() < 0.6, rnd.random() < 0.4 or None) for k in range(130)]
    df = spark.createDataFrame(data + data[:9] + [(900, None), (None, "x")], "id bigint, t string").withColumn("train", F.lit(1))
    got = [(r.train_id, r.held_id) for r in overlap.cross_split(df, "id", df["t"], spark.createDataFrame(flags, "id bigint, train boolean, held boolean"), hot=hot).collect()]
    own = {k: (t, h) for k, t, h in flags}
    sets = [(k, set(t.split())) for k, t in data if k in own]
    both = near(sets, 7, 10, 10)
    want = {(a, b) for x in both for a, b in (x, x[::-1]) if own[a][0] and own[b][1]}
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(want) >= 15
    assert set(got) == want if moved else len(got) >= 0.99 * len(want)


def flows(pairs, inflation=2.0, prune=1e-3, rounds=100):
    """Markov clustering of one whole dense matrix, by its definition: {vertex: (cluster, mass)}."""
    ids = sorted({x for a, b, _ in pairs for x in (a, b)})
    m = np.zeros((len(ids), len(ids)))
    for a, b, s in pairs:
        m[ids.index(a), ids.index(b)] = m[ids.index(b), ids.index(a)] = s
    m += np.diag(m.max(axis=0))
    m /= m.sum(axis=0)
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m = np.where(m >= prune * m.max(axis=0), m, 0)
        m /= m.sum(axis=0)
    to = [(ids[j], ids[int(np.flatnonzero(m[:, j] >= 0.9 * m[:, j].max())[0])]) for j in range(len(ids))]
    part = dict((x, g) for g, x in closed(to))
    return {j: (part[j], m[k].sum()) for k, j in enumerate(ids)}


def communities(seed, groups=12):
    """Dense groups with weak edges between them, a path, a star, and pairs."""
    rnd = random.Random(seed)
    out, at = {}, 0
    for _ in range(groups):
        n = rnd.randint(2, 9)
        for a in range(at, at + n):
            for b in range(a + 1, at + n):
                if rnd.random() < 0.8:
                    out[a, b] = rnd.uniform(0.5, 1)
        if at and rnd.random() < 0.7:
            out[rnd.randrange(at), at] = rnd.uniform(0.05, 0.4)
        at += n
    for k in range(9):
        out[500 + k, 501 + k] = rnd.uniform(0.3, 1)
    for k in range(20):
        out[600, 601 + k] = rnd.uniform(0.3, 1)
    return [(a, b, s) for (a, b), s in out.items()]


@pytest.mark.parametrize("small", [markov.SMALL, 10])
def test_markov_clusters(spark, small):
    pairs = communities(3)
    m = markov.MarkovClusters(spark.createDataFrame(pairs, "a bigint, b bigint, sim double"), Scratch(spark), small=small)
    got = {r.j: (r.block, r.i, r.mass) for r in m.vertices.collect()}
    want = flows(pairs)
    assert m.unsettled == 0
    assert {j: i for j, (_, i, _) in got.items()} == {j: i for j, (i, _) in want.items()}
    assert all(math.isclose(got[j][2], want[j][1], abs_tol=0.02) for j in want)
    assert {(b, j) for j, (b, _, _) in got.items()} == closed((a, b) for a, b, _ in pairs)
    assert len({i for i, _ in want.values()}) > len({b for b, _, _ in got.values()})


def test_no_markov_clusters(spark):
    none = markov.MarkovClusters(spark.createDataFrame([], "a bigint, b bigint, sim double"), Scratch(spark))
    assert none.vertices.count() == 0
    assert none.unsettled == 0


@pytest.mark.parametrize("small", [markov.SMALL, 8])
def test_question_clusters(spark, small):
    data = texts(90, 17, vocab=200)
    kinds = ["History", "HISTORY ", "Science -- Math", "math", None, "unknown"]
    q = spark.createDataFrame([(k, kinds[k % 6]) for k in range(85)] * 2 + [(3, "Music")], "question_id bigint, category string").withColumn("own", F.lit(1))
    f = spark.createDataFrame([(k, p, w.upper() + " ") for k, t in data for p, w in enumerate(t.split())] + [(1, 1, None), (None, 1, "x")], "question_id bigint, token_offset int, feature string")
    v = spark.createDataFrame([("v0", 1, 1), ("v1", 0, 2), (None, 1, 3)], "feature string, censored int, word_id int")
    graph, flow = markov.clusters(f, q, v, small=small)
    got = {tuple(r) for r in markov.joined_clusters(graph, flow).collect()}
    sets = [(k, set(t.split()) - {"v0"}) for k, t in data[:85]]
    pairs = [(a, b) for a, b in near(sets, 3, 10, 10) if (a % 6) // 2 == (b % 6) // 2]
    assert got == closed(pairs, 3)
    # each Markov cluster with its size and most typical members, against the whole matrix
    own = dict(sets)
    cid = {}
    for k, s in sets:
        if len(s) >= 10:
            cid[k] = next(x for x, t in sets if t == s and (x % 6) // 2 == (k % 6) // 2)
    edges = {(cid[a], cid[b]): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in pairs if cid[a] != cid[b]}
    want = flows([(*sorted(x), s) for x, s in edges.items()])
    members = {}
    for k, c in cid.items():
        members.setdefault(want[c][0] if c in want else c, set()).add(k)
    shown = {r.cluster_id: (r.size, r.typical) for r in markov.described(graph, flow).collect()}
    assert {c: n for c, (n, _) in shown.items()} == {min(x): len(x) for x in members.values() if len(x) > 1}
    for c, (_, typical) in shown.items():
        mass = {j: m for j, (i, m) in want.items() if i == want.get(cid[c], (None,))[0]} or {cid[c]: 1.0}
        listed = [int(x) for x in typical.split(",")]
        assert len(listed) == min(3, len(mass))
        assert all(mass[listed[-1]] >= m - 0.02 for j, m in mass.items() if j not in listed)


def test_without_the_flow_there_are_no_clusters(spark):
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in ((1, 2), (2, 3), (3, 4))], "a bigint, b bigint, sim double")
    m = markov.MarkovClusters(pairs, Scratch(spark))
    graph = SimpleNamespace(members=spark.createDataFrame([(k, k) for k in (1, 2, 3, 4)], "id bigint, cid bigint"))
    assert {tuple(r) for r in markov.joined_clusters(graph, m).collect()} == {(1, k) for k in (1, 2, 3, 4)}
    m.vertices = m.vertices.where("j > 2")
    assert markov.joined_clusters(graph, m).count() == 0


@pytest.mark.parametrize(("least", "small"), [(1.0, markov.SMALL), (0.3, markov.SMALL), (0.3, 0)])
def test_a_clique_larger_than_one_over_prune(spark, least, small):
    rnd = random.Random(3)
    pairs = spark.createDataFrame([(a, b, rnd.uniform(least, 1)) for a in range(30) for b in range(a + 1, 30)], "a bigint, b bigint, sim double")
    m = markov.MarkovClusters(pairs, Scratch(spark), spark.createDataFrame([(5, 40)], "a bigint, b bigint"), prune=0.05, small=small)
    assert {(r.j, r.block, r.i) for r in m.vertices.collect()} == {(k, 0, 0) for k in range(30)}
    graph = SimpleNamespace(members=spark.createDataFrame([(k, k) for k in range(30)] + [(40, 5)], "id bigint, cid bigint"))
    assert {tuple(r) for r in markov.joined_clusters(graph, m).collect()} == {(0, k) for k in [*range(30), 40]}


def test_copies_without_neighbours_are_a_cluster(spark):
    sets = {k: [f"{g}{x}" for x in range(12)] for g, ids in {"a": (1, 2, 3), "b": (4, 5), "c": (6,), "d": (7, 8)}.items() for k in ids}
    sets[8] = [*sets[7][1:], "other"]  # like 7, not the same
    q = spark.createDataFrame([(k, "History") for k in sets], "question_id bigint, category string")
    f = spark.createDataFrame([(k, p, w) for k, s in sets.items() for p, w in enumerate(s)], "question_id bigint, token_offset int, feature string")
    v = spark.createDataFrame([], "feature string, censored int, word_id int")
    graph, flow = markov.clusters(f, q, v)
    assert {tuple(r) for r in markov.described(graph, flow).select("cluster_id", "size").collect()} == {(1, 3), (4, 2), (7, 2)}
    assert {tuple(r) for r in markov.joined_clusters(graph, flow).collect()} == {(1, 1), (1, 2), (1, 3)}
    assert {tuple(r) for r in markov.described(*markov.clusters(f.where("question_id < 6"), q, v)).collect()} == {(1, 3, "1"), (4, 2, "4")}


def test_flows_settle(spark):
    path = spark.createDataFrame([(k, k + 1, 1.0) for k in range(13)], "a bigint, b bigint, sim double")
    m = markov.MarkovClusters(path, Scratch(spark))
    assert m.rounds > 12
    assert m.unsettled == 0


@pytest.mark.parametrize("small", [markov.SMALL, 0])
def test_attractors_are_followed_to_their_end(spark, small):
    chain = spark.createDataFrame([(k, k + 1, 10.0**k) for k in range(8)], "a bigint, b bigint, sim double")
    m = markov.MarkovClusters(chain, Scratch(spark), rounds=1, small=small)
    graph = SimpleNamespace(members=spark.createDataFrame([(k, k) for k in range(9)], "id bigint, cid bigint"))
    assert m.unsettled > 0
    with pytest.warns(UserWarning, match="settled after 1 rounds"):
        assert [(r.cluster_id, r.size) for r in markov.described(graph, m).collect()] == [(0, 9)]
