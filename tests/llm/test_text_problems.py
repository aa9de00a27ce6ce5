from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import canonical, leaks, mixing, quality

# ---------------------------------------------------------------- problem 1

ENTRIES = [(1, "Battle of Cegliburn"), (2, "Lake Ruvurirk"), (3, "Ruvurirk's law"), (4, "Gleabelaur I"), (5, "Gleabelaur II"), (6, "Copalux (opera)"), (7, "Copalux (play)"), (8, "Edkend Jiglarix"), (9, "Ropit Kigleala"), (10, "The Ledger of Dupralend"), (11, None)]
TYPED = {
    "battle at ceglibrn": 1, "L. Ruvurirk": 2, "ruvurirk's law??": 3, "Gleabelaur the Second": 5, "i think gleabelaur i": 4, "the opera copalux": 6, "COPALUX [play]": 7, "Copalux": -1,
    "Jiglarix, Edkend": 8, "answer: kiglaela": 9, "TheLedgerofDupralend": 10, "Edkend Thochostos": -1, "Lake Stesaugleck": -1, "idk": -1, "???": -1, "Gleabelaur III": -1,
    "Battle of Cegliburn [or battle of cegliburn]": 1, "bàttle of cégliburn (not sure)": 1,
}


@pytest.mark.parametrize("most", [1000, 4, 1])
def test_values_are_mapped(spark, most):
    v = spark.createDataFrame([(t, 1) for t in TYPED] * 2 + [(None, 1), (" \t", 2), ("", 3)], "value string, score int")
    e = spark.createDataFrame(ENTRIES, "entry_id bigint, t string")
    got = {r.value: r.entry_id for r in canonical.map_values(v, "value", e, "entry_id", "t", most=most).collect()}
    assert got == TYPED


def test_a_value_of_two_entries_in_different_indexes(spark):
    e = spark.createDataFrame([(k, f"Copalux {w}") for k, w in enumerate(["opera", "play", "novel", "symphony", "painting", "ballet"])] + [(20, "Lake Ruvurirk"), (21, "Edkend Jiglarix")], "entry_id bigint, t string")
    v = spark.createDataFrame([("copalux",), ("copalux play",), ("lake ruvurirk",)], "value string")
    got = [{r.value: r.entry_id for r in canonical.map_values(v, "value", e, "entry_id", "t", most=most).collect()} for most in (1000, 4, 2, 1)]
    assert got == [{"copalux": -1, "copalux play": 1, "lake ruvurirk": 20}] * 4


def invented(seed, entries=300, values=900):
    """Entries of common and own words with look-alikes, and typed values with the entry they stand for."""
    rnd = random.Random(seed)
    own = lambda: "".join(rnd.choice("bcdfgklmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 4))) + rnd.choice("lnrstx")
    kinds = ["Lake {}", "River {}", "{}'s law", "Treaty of {}", "{} (opera)", "{} (play)", "{} I", "{} II", "First Battle of {}", "Second Battle of {}", "Orkend {}", "Kapix {}"]
    names = [own() for _ in range(entries)]
    listed = list(dict.fromkeys(k.format(n.title()) for n in names for k in rnd.sample(kinds, rnd.choice([1, 1, 2]))))
    known, typed = set(names), []
    for _ in range(values):
        e = rnd.randrange(len(listed))
        t = listed[e]
        if rnd.random() < 0.2:
            fresh = own()
            if all(canonical.distance(fresh, n, 3) > 3 for n in known):
                typed.append((rnd.choice(kinds).format(fresh), -1))
            continue
        if rnd.random() < 0.5:
            w = max(t.split(), key=len)
            at = rnd.randrange(1, len(w) - 1)
            x = rnd.choice([w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[:at] + w[at + 1] + w[at] + w[at + 2 :]])
            t = t.replace(w, x)
        t = rnd.choice([str, str.lower, str.upper, lambda s: f"I think {s.lower()}", lambda s: f" {s}?"])(t)
        typed.append((t, e))
    return listed, typed


def test_threshold_and_margin_decide(spark):
    listed, typed = invented(5)
    e = spark.createDataFrame(list(enumerate(listed)), "i bigint, t string")
    v = spark.createDataFrame(typed, "v string, truth bigint")
    read = lambda **kw: {r.value: (r.entry_id, r.score) for r in canonical.map_values(v, "v", e, "i", "t", **kw).collect()}
    one = read()
    assert sum(one[t][0] == i for t, i in typed) >= 0.99 * len(typed)
    assert read(most=90) == one  # four indexes, equal to the last digit
    loose = read(threshold=0.0, margin=0.0)  # without the two numbers every value with a candidate is mapped
    refused = {t for t, i in typed if i < 0}
    assert sum(one[t][0] < 0 for t in refused) >= 0.98 * len(refused)
    assert sum(loose[t][0] >= 0 for t in refused) >= 0.5 * len(refused)
    assert all(i == -1 for i, _ in read(threshold=1.01).values())


def test_no_entries(spark):
    v = spark.createDataFrame([("a",)], "v string")
    e = spark.createDataFrame([], "i bigint, t string")
    assert [tuple(r)[:2] for r in canonical.map_values(v, "v", e, "i", "t").collect()] == [("a", -1)]
    assert canonical.map_values(v.limit(0), "v", e, "i", "t").count() == 0


def test_distance():
    assert canonical.distance("abcd", "abdc", 2) == 1
    assert canonical.distance("abcd", "abcd", 2) == 0
    assert canonical.distance("abcdef", "xyzuvw", 2) == 3
    assert canonical.distance("", "ab", 2) == 2
    assert canonical.distance("aab", "aaab", 2) == 1


def test_alike_words_are_all_found():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(5, 9)))
    words = sorted({word() for _ in range(600)} | {"été1", "ab"})
    index = canonical.Words(words)
    for w in [word() for _ in range(200)]:
        most = canonical.allowed(w)
        want = {x for x in words if canonical.bigrams(x) & canonical.bigrams(w) and canonical.distance(w, x, 2) <= min(most, canonical.allowed(x))}
        assert set(index.alike(w)) == want


# ---------------------------------------------------------------- problem 8


def test_suffix_array_and_search():
    rnd = random.Random(1)
    for _ in range(20):
        seq = np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))] + [0])
        assert leaks.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
        index = leaks.FMIndex(seq, 6, every=4)
        phrases = np.array([[rnd.randint(1, 5) for _ in range(3)] for _ in range(30)])
        row, low, high = index.search(phrases)
        found = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, low, high, strict=True)}
        for r, p in enumerate(phrases.tolist()):
            assert found.get(r, []) == [i for i in range(len(seq) - 2) if seq[i : i + 3].tolist() == p]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_leaks(spark, size):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(30)] + ["été", "İx"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(n))) for k, n in enumerate([30, 25, 12, 11, 0])] + [(9, None), (None, "x")]
    docs = []
    for k in range(40):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            w = (items[rnd.randint(0, 3)][1]).split()
            a = rnd.randint(0, len(w) - 5)
            p = rnd.randint(0, len(words))
            words[p:p] = w[a : a + rnd.randint(5, 20)]
        docs.append((k, ",\n".join(words).upper()))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (None, "x")]
    want = {}
    for d, t in docs:
        w = leaks.text_words(t or "")
        for i, u in items:
            v = leaks.text_words(u or "")
            grams = {tuple(v[k : k + 12]) for k in range(len(v) - 11)}
            hit = {k + j for k in range(len(w) - 11) if tuple(w[k : k + 12]) in grams for j in range(12)}
            if hit and d is not None and i is not None:
                want[d, i] = (sum(k - 1 not in hit for k in hit), len(hit))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, item_text string")
    for most, piece in ((1000, 1000), (30, 7)):
        got = {(r.doc_id, r.item_id): (r.spans, r.words) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "item_text", size=size, most=most, piece=piece).collect()}
        assert got == want
    assert leaks.leaks(df, "doc_id", "text", it.limit(0), "item_id", "item_text").count() == 0
    assert leaks.leaks(df.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0


# ---------------------------------------------------------------- problem 9


def test_mix_meets_its_budgets(spark):
    rnd = random.Random(4)
    docs = [(k, " ".join(["alpha beta", "gamma"][rnd.randint(0, 1)] for _ in range(rnd.randint(1, 30))), rnd.choice(["Big_One", "big-one ", "small", "other", None])) for k in range(120)]
    docs += [(500, None, "small"), (501, "", "small"), (None, "x", "small")]
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.3, 3), ("missing", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    m = mixing.Mix(df, "doc_id", "text", "source", targets, total=1500)
    encode = mixing.encoding(mixing.RANKS, mixing.PATTERN).encode_ordinary
    size = {d: len(encode(t)) for d, t, _ in docs if t and d is not None}
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["missing"].taken == 0
    for source, share, cap in (("big_one", 0.5, 1), ("small", 0.3, 3)):
        own = [d for d, t, s in docs if s and t and d is not None and s.strip().lower().replace("-", "_") == source]
        assert shares[source].available == sum(size[d] for d in own)
        assert shares[source].taken == min(int(share * 1500), cap * shares[source].available)
        got = m.chosen.where(F.col("source") == source).collect()
        assert sum(r.tokens * (r.repeats - 1) + r.last_tokens for r in got) == shares[source].taken
        assert all(r.tokens == size[r.doc_id] and 1 <= r.repeats <= cap for r in got)
        assert sum(r.last_tokens < r.tokens for r in got) <= 1
    again = mixing.Mix(df.repartition(7), "doc_id", "text", "source", targets, total=1500)
    assert sorted(map(tuple, again.chosen.collect())) == sorted(map(tuple, m.chosen.collect()))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, "doc_id", "text", "source", targets)
    assert m.chosen.count() == 0
    assert [r.taken for r in m.shares.collect()] == [0]


# ---------------------------------------------------------------- problem 10


def test_text_stats():
    s, ids = quality.text_stats("The cat sat. \n- x 12\n", {"the": 1})
    stats = dict(zip((k for k, _ in quality.STATS), s, strict=True))
    assert (stats["words"], stats["lines"], stats["stops"]) == (5, 2, 1)
    assert stats["common"] == 0.2
    assert stats["ended_lines"] == 0.5
    assert stats["bullets"] == 0.5
    assert ids.tolist() == [1, 0, 0, 0, 0]


def test_learned_votes_beat_the_noisy_one():
    rnd = np.random.default_rng(0)
    truth = rnd.integers(0, 2, 4000)
    votes = np.stack([np.where(rnd.random(4000) < q, truth, 1 - truth) for q in (0.95, 0.95, 0.9, 0.55)], axis=1)
    patterns, back, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.learn(patterns, count.astype(float))[back.ravel()]
    assert ((post[:, 0] < 0.5) == (truth == 1)).mean() > 0.95


def test_types(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    prose = lambda: " ".join(f"The {name()} of the {name()} was {name()} by a {name()} in the {name()} that had {name()} it." for _ in range(6))
    table = lambda: "\n".join(f"| {name()} | {name()} | {rnd.randint(1, 99)} |" for _ in range(12))
    listed = lambda: "\n".join(f"- {name()} {name()}" for _ in range(15))
    docs = [(k, (prose, prose, table, listed)[k % 4]()) for k in range(160)] + [(1000, None), (1001, " \n\t"), (None, prose()), (1002, "railway " * 60)]
    words = spark.createDataFrame([(w,) for w in ["the", "of", "was", "by", "a", "in", "that", "had", "it", None, "the"]], "word string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("order", F.lit(1))
    got = {r.doc_id: r for r in quality.text_quality(df, "doc_id", "text", words, "word").collect()}
    assert got.keys() == {*range(160), 1002}
    assert all((got[k].p_prose >= 0.5) == (k % 4 < 2) for k in range(160))
    assert got[1002].p_prose < 0.5
    assert quality.text_quality(df.limit(0), "doc_id", "text", words, "word").count() == 0
