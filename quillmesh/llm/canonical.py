"""Problem 1: mapping free-entered values to a canonical list.

Values are deduplicated and normalised. An inverted index of character n-grams
over the list's words finds the words that a typed word may stand for, and
their entries are the candidates. These are scored by a soft cosine: words
weigh by how few entries hold them, and two words a few edits apart count as
partly the same. The best candidate is accepted above a threshold and a margin
over the second best; nothing else decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import WHITE
from quillmesh.session import tasks

#: Fixed values of the normaliser: what typists add, words that say nothing, and ways to write a small number.
FILLER = re.compile(r"^\s*(?:(?:the\s+)?answer(?:\s+is|\s*:)|i\s+think|is\s+it|uh+|um+|maybe|perhaps)(?![^\W_])|(?:\(\s*not\s+sure\s*\)|\bnot\s+sure|\bmaybe|\bi\s+think)[\s?.!]*$|\[\s*or\s[^\]]*\]?")
DROPPED = {"of", "the", "at", "a", "an"}
NUMBERS = {"1st": 1, "first": 1, "one": 1, "i": 1, "2nd": 2, "second": 2, "ii": 2, "3rd": 3, "third": 3, "iii": 3, "4th": 4, "fourth": 4, "iv": 4, "5th": 5, "fifth": 5, "v": 5, "sixth": 6, "vi": 6, "seventh": 7, "vii": 7, "eighth": 8, "viii": 8}
ROMAN = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii"}
#: Entries whose index is handed to every task; longer lists are searched in several indexes.
MOST_ENTRIES = 100_000
#: Least score of an accepted entry, and its least lead over the next. Between
#: a value that shares all but its own name with an entry (0.5 at most) and a
#: name with two edits (0.65 at least, also where the value leaves out the rest).
THRESHOLD, MARGIN = 0.6, 0.02
#: Words held by no more entries than this, or this share of them, all weigh the same.
FEW, SHARE = 3, 1 / 1000
#: What an edit takes off the likeness of two words, and the likeness of a name to its initial.
EDIT, INITIAL = 0.1, 0.6
#: Weight of a lone letter, as a share of a rare word's.
LETTER = 0.4


def plain(text: str) -> str:
    """Lower case without accents, filler, possessives and apostrophes."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    old = None
    while old != t:
        old, t = t, FILLER.sub(" ", t)
    return re.sub(r"['’]s\b|['’]", "", t)


def tokens(text: str) -> list[str]:
    """Normalised words of a value: no case, accents, punctuation or filler; small numbers as ``#n``; single letters as ``l.``."""
    words = re.findall(r"[^\W_]+", plain(text))
    out = []
    for k, w in enumerate(words):
        last = k == len(words) - 1 and k > 0
        if w.isdigit() and len(w) <= 2:
            out.append(f"#{int(w)}")
        elif w in NUMBERS and (w not in ROMAN or last):
            out.append(f"#{NUMBERS[w]}")
        elif len(w) == 1 and w != "a":
            out.append(f"{w}.")
        elif w not in DROPPED:
            out.append(w)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b; most + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    i, j = len(a), len(b)
    while min(i, j) > start and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    a, b = a[start:i], b[start:j]
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(a: str) -> int:
    """Most edits to a word that may still be the same: two, or one if it is short."""
    return 1 if len(a) < 5 else 2


def few(n: int) -> float:
    """Entries up to which the frequency of a word in a list of n doesn't matter."""
    return max(FEW, n * SHARE)


def bigrams(word: str) -> set[str]:
    """Distinct character pairs of a word with its ends marked."""
    p = f"^{word}$"
    return {p[k : k + 2] for k in range(len(p) - 1)}


NONE = np.zeros(0, np.int32)


class Words:
    """Inverted index of character n-grams over distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        at = defaultdict(list)
        for k, w in enumerate(words):
            for g in bigrams(w):
                at[g].append(k)
        self.at = {g: np.array(v, np.int32) for g, v in at.items()}
        self.size = np.array([len(w) for w in words], np.int16)
        self.bags = np.stack([self._bag(w) for w in words]) if words else np.zeros((0, 32), np.int16)
        self.seen: dict[str, dict[str, float]] = {}

    @staticmethod
    def _bag(word: str) -> np.ndarray:
        return np.bincount([ord(c) & 31 for c in word], minlength=32).astype(np.int16)

    def alike(self, word: str) -> dict[str, float]:
        """Words that share a character pair with ``word`` and are few edits apart, with their likeness: 1 less ``EDIT`` for each edit.

        No edit undoes more than three pairs, so one pair more than that
        finds them all, and the rarest do. Words whose letters differ too much
        whatever their order are passed over without counting edits.
        """
        out = self.seen.get(word)
        if out is not None:
            return out
        own, most, out = bigrams(word), allowed(word), {}
        hits = sorted((self.at.get(g, NONE) for g in own), key=len)[: 3 * most + 1]
        k = np.concatenate(hits)
        if len(k):
            k = np.unique(k[np.abs(self.size[k] - len(word)) <= most])
            apart = self.bags[k] - self._bag(word)
            k = k[np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= most]
            for x in k.tolist():
                other = self.words[x]
                least = min(most, allowed(other))
                d = distance(word, other, least)
                if d <= least:
                    out[other] = 1.0 - EDIT * d
        if len(self.seen) >= 100_000:
            self.seen.clear()
        self.seen[word] = out
        return out


def run_together(value: str, typed: list[str]) -> str:
    """A value's words without the spaces between them, numbers left out."""
    if any(w[0] == "#" for w in typed):
        return "".join(w.rstrip(".") for w in typed if w[0] != "#")
    return "".join(re.findall(r"[^\W_]+", plain(value)))


class Index:
    """A list of entries that is searched by soft cosine.

    Args:
        entries: ``(id, text)``.
        usual: how many entries hold a word, for the words that more than
            :func:`few` hold, counted over the whole list.
        n: entries of the whole list.
        threshold, margin: of acceptance; scores too low to matter for it
            needn't be found.
    """

    def __init__(self, entries: list[tuple[int, str]], usual: dict[str, int], n: int, threshold: float = THRESHOLD, margin: float = MARGIN):
        own = [(i, t, list(dict.fromkeys(tokens(t)))) for i, t in sorted((int(i), t) for i, t in entries if t)]
        own = [x for x in own if x[2]]
        self.ids, self.own = [x[0] for x in own], [x[2] for x in own]
        self.threshold, self.least = threshold, threshold - margin
        self.rare = math.log(1 + n / few(n))
        self.usual = {w: math.log(1 + n / c) for w, c in usual.items()}
        self.norm = [math.sqrt(sum(self.weight(w) ** 2 for w in ws)) for ws in self.own]
        self.at, whole = defaultdict(list), defaultdict(list)
        for e, (_, text, ws) in enumerate(own):
            for w in ws:
                self.at[w].append(e)
            whole[run_together(text, ws)].append(e)
        self.whole = dict(whole)
        self.words = Words(sorted(w for w in self.at if w[0] != "#" and w[-1] != "."))
        self.wholes = Words(sorted(w for w in self.whole if w))

    def weight(self, word: str) -> float:
        """Numbers weigh like rare words, lone letters less."""
        if word[0] == "#":
            return self.rare
        return LETTER * self.rare if word[-1] == "." else self.usual.get(word, self.rare)

    def _alike(self, word: str) -> dict[str, float]:
        return {word: 1.0} if word[0] == "#" or word[-1] == "." else self.words.alike(word)

    def by_words(self, typed: list[str]) -> list[tuple[float, int]]:
        """The two best entries as (cosine, id), word against word.

        Words that are alike but not the same count with the lesser of their
        weights, so that a usual word isn't taken for a name. The weightiest
        words look for candidates first, and only those look with which, and
        with what follows, an entry can still reach the threshold.
        """
        ws = sorted(((self.weight(w), w) for w in typed), key=lambda x: (x[1][0] == "#", -x[0], x[1]))  # numbers find too many
        norm = math.sqrt(sum(x * x for x, _ in ws))
        least = self.least * norm - 1e-9
        left, found, near = norm * norm, set(), defaultdict(list)
        for x, w in ws:
            first = left >= least * least
            left = max(0.0, left - x * x)
            rest = math.sqrt(left)
            for v, s in self._alike(w).items():
                y = self.weight(v)
                p = s * min(x, y) ** 2
                near[v].append((p, w))
                if first:  # no word before this one is met, and what follows brings `rest` at most
                    for e in self.at.get(v, ()):
                        if e not in found and p + rest * math.sqrt(max(0.0, self.norm[e] ** 2 - y * y)) >= least * self.norm[e]:
                            found.add(e)
        letters = {w for w in typed if w[-1] == "."}
        best = []
        for e in found:
            own = self.own[e]
            hits = [(p, w, v) for v in own for p, w in near.get(v, ())]
            if letters and len(own) > 1 and f"{own[0][0]}." in letters:
                hits.append((LETTER * self.rare * self.weight(own[0]) * INITIAL, f"{own[0][0]}.", own[0]))  # an initial says as much as it weighs
            score, used = 0.0, set()
            for p, w, v in sorted(hits, reverse=True):  # each word counts once on either side
                if (0, w) not in used and (1, v) not in used:
                    used |= {(0, w), (1, v)}
                    score += p
            best.append((score / (norm * self.norm[e]), self.ids[e]))
        return sorted(best, key=lambda b: (-b[0], b[1]))[:2]

    def by_whole(self, value: str, typed: list[str]) -> list[tuple[float, int]]:
        """The two best entries as (cosine, id), with all words but numbers taken as one, for words run together or torn apart."""
        one = run_together(value, typed)
        if len(one) < 6:
            return []
        number = {w for w in typed if w[0] == "#"}
        best = []
        for v, s in self.wholes.alike(one).items():
            for e in self.whole[v]:
                own = {w for w in self.own[e] if w[0] == "#"}
                each = self.rare * self.rare
                words = max(self.norm[e] ** 2 - len(own) * each, 1e-9)
                score = (words * s + len(own & number) * each) / math.sqrt((words + len(own) * each) * (words + len(number) * each))
                best.append((score, self.ids[e]))
        return sorted(best, key=lambda b: (-b[0], b[1]))[:2]

    def match(self, value: str) -> list[tuple[bool, float, int]]:
        """Candidates as (as one word, cosine, id): the two best by words and, where none of them will do, the two best as one word."""
        typed = list(dict.fromkeys(tokens(value)))
        if not typed:
            return []
        out = [(False, *b) for b in self.by_words(typed)]
        if not out or out[0][1] < self.threshold:
            out += [(True, *b) for b in self.by_whole(value, typed)]
        return out


#: Candidates of a value.
CANDIDATES = "c array<struct<whole boolean, down double, id bigint>>"


def _matches(shared):
    """Distinct values to (value, candidates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        seen: dict[tuple, list] = {}
        kind = pa.list_(pa.struct([("whole", pa.bool_()), ("down", pa.float64()), ("id", pa.int64())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(start, 4096)
                rows = []
                for v in part.to_pylist():
                    key = plain(v)  # spellings that come to the same are looked up once in a task
                    if key not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen[key] = [{"whole": w, "down": -s, "id": i} for w, s, i in index.match(v)]
                    rows.append(seen[key])
                yield pa.RecordBatch.from_arrays([part, pa.array(rows, kind)], names=["value", "c"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries to their distinct words, one row each."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column(0).to_pylist() for w in set(tokens(t))], pa.string())], names=["w"])


def map_values(values: DataFrame, value: str, entries: DataFrame, entry_id: str, entry_text: str, threshold: float = THRESHOLD, margin: float = MARGIN, most: int = MOST_ENTRIES) -> DataFrame:
    """The entry that each distinct value stands for.

    Args:
        values, value: the table with the free-entered column.
        entries, entry_id, entry_text: the canonical list; null texts are no
            entries, of equal texts the smallest id counts.
        threshold, margin: least soft cosine of the best entry, and least lead
            over the next, for it to be accepted.
        most: entries in one index. A longer list is searched in several
            indexes with the weights of the whole list; the two best of all
            of them decide, so the result is the same.

    Returns:
        ``(value, entry_id, score)``, one row per distinct value that is
        neither null nor blank; ``entry_id`` is -1 where the value stands for
        none, and the score that of the nearest candidate, 0 without any.
    """
    spark = values.sparkSession
    listed = (
        entries.select(entries[entry_id].cast("bigint").alias("i"), entries[entry_text].alias("t"))
        .where("i is not null and t is not null")
        .groupBy("t")
        .agg(F.min("i").alias("i"))
        .select("i", "t")
    )
    counts = listed.select("t").mapInArrow(_words, "w string").groupBy("w").count()
    n = listed.count()
    usual = {r[0]: r[1] for r in counts.where(F.col("count") > few(n)).collect()}  # at most 1 / SHARE times the words of an entry
    shards = max(1, -(-n // most))
    distinct = values.select(values[value].alias("value")).where(F.btrim("value", F.lit(WHITE)) != "").distinct()
    # spellings of one value meet in one task, which looks them up once
    distinct = distinct.repartition(tasks(spark), F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]", ""))
    found = None
    for k in range(shards):
        part = listed.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == k).collect()  # about `most` rows
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part], usual, n, threshold, margin))
        hits = distinct.mapInArrow(_matches(index), f"value string, {CANDIDATES}")
        found = hits if found is None else found.unionByName(hits)
    if shards > 1:  # the two best of all indexes are among the two best of each
        found = found.groupBy("value").agg(F.flatten(F.collect_list("c")).alias("c"))
    of = lambda whole: F.array_sort(F.filter("c", lambda x: x["whole"] == whole))
    first, one = of(False), of(True)
    top = lambda x, k: F.coalesce(-F.try_element_at(x, F.lit(k))["down"], F.lit(0.0))
    pick = F.when((top(first, 1) >= threshold) | (F.size(one) == 0), first).otherwise(one)
    ranked = found.select("value", pick.alias("p")).select("value", F.try_element_at("p", F.lit(1))["id"].alias("id"), top(F.col("p"), 1).alias("score"), top(F.col("p"), 2).alias("second"))
    good = (F.col("score") >= threshold) & (F.col("score") - F.col("second") >= margin)
    return ranked.select("value", F.when(good, F.col("id")).otherwise(F.lit(-1)).cast("bigint").alias("entry_id"), "score")
