"""Problem 8: evaluation texts leaking into training text, by an FM-index per shard.

The words of a shard of documents become one sequence of symbols, over which a
suffix array, its Burrows-Wheeler transform and a wavelet matrix for ranks are
built. All test phrases are searched backwards at once; occurrences are placed
by walking to sampled suffix positions, and hits that overlap are merged to
spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import Scratch

WORD = re.compile(r"[^\W_]+")
#: Symbols in a shard.
SHARD = 1 << 20
#: Words of items whose phrases are searched in one pass, and words of a piece of a long item.
MOST_WORDS, PIECE = 1 << 20, 4096
#: Symbols: the end of the sequence, any word that no phrase holds, then the phrases' words.
END, OTHER, FIRST = 0, 1, 2


def text_words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    if "İ" in text:  # its lower case holds a combining mark
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the groups still tied."""
    n, base = len(seq), int(seq.max()) + 1
    depth = max(1, min(8, int(62 // max(1, base.bit_length()))))
    padded = np.concatenate([seq.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key * base + padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(tied):
        i = sa[tied]
        ahead = i + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[i] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        i, both = i[order], both[order]
        sa[tied] = i
        new = np.r_[True, both[1:] != both[:-1]]
        rank[i] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        depth *= 2
    return sa


class FMIndex:
    """Backward search over a sequence of symbols below ``symbols`` that ends with a single ``END``."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = 16):
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))][:symbols]
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = bwt
        for level in reversed(range(self.levels)):
            bit = ((cur >> level) & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.start = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.sampled = np.r_[0, np.cumsum(sa % every == 0, dtype=np.int32)]
        self.place = sa[sa % every == 0]

    def _descend(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self.ones[k][p]
            p = np.where((c >> level) & 1, self.zeros[k] + ones, p - ones)
        return p

    def rank(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first p symbols of the transform."""
        return self._descend(c, p) - self.start[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur: their row, and the interval of suffixes that begin with them."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their place in the suffix order."""
        out, todo, at = np.empty(len(at), np.int64), np.arange(len(at)), at.astype(np.int64)
        steps = 0
        while len(todo):
            known = self.sampled[at + 1] > self.sampled[at]
            out[todo[known]] = self.place[self.sampled[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            p, c = at, np.zeros(len(at), np.int64)
            for k in range(self.levels):
                ones = self.ones[k][p]
                bit = self.ones[k][p + 1] - ones
                c = c * 2 + bit
                p = np.where(bit, self.zeros[k] + ones, p - ones)
            at = self.before[c] + p - self.start[c]
            steps += 1
        return out


class Phrases:
    """All runs of ``length`` words of the items, as symbols, with the items that hold each."""

    def __init__(self, items: list[tuple[int, list[str]]], length: int):
        self.length = length
        self.symbol: dict[str, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            s = [self.symbol.setdefault(w, len(self.symbol) + FIRST) for w in words]
            for k in range(len(s) - length + 1):
                rows.setdefault(tuple(s[k : k + length]), set()).add(item)
        self.phrases = np.array(list(rows), np.int64).reshape(-1, length)
        self.items = [sorted(x) for x in rows.values()]


def _pieces(length: int, piece: int):
    """Items (i, text) to pieces (i, words, n) of long ones, with an overlap that keeps every phrase whole; none of items that are too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = text_words(text)
                rows += [(item, x, len(x)) for x in (w[k : k + piece + length - 1] for k in range(0, len(w) - length + 1, piece))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.int64()))], names=["i", "t", "n"])

    return run


def _spans(shard: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, first word, end) of the spans of a shard of (doc, first word, symbols)."""
    pieces, doc, word = [], [], []
    for d, first, s in shard:
        s = np.r_[s, OTHER]  # no phrase runs from one document into the next
        keep = np.r_[True, (s[1:] != OTHER) | (s[:-1] != OTHER)]
        pieces.append(s[keep])
        word.append(np.flatnonzero(keep) + first)
        doc.append(np.full(len(pieces[-1]), d))
    seq, doc, word = np.r_[np.concatenate(pieces), END], np.concatenate(doc), np.concatenate(word)
    index = FMIndex(seq, FIRST + len(phrases.symbol))
    row, low, high = index.search(phrases.phrases)
    count = high - low
    at = index.locate(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    hits = sorted((int(doc[p]), item, int(word[p])) for r, p in zip(np.repeat(row, count), at, strict=True) for item in phrases.items[r])
    last: list[int] | None = None
    for d, item, w in hits:
        if last and last[0] == d and last[1] == item and w <= last[3]:
            last[3] = w + phrases.length
        else:
            if last:
                yield tuple(last)
            last = [d, item, w, w + phrases.length]
    if last:
        yield tuple(last)


def _search(shared, size: int):
    """Documents (doc, text) to spans (doc_id, item_id, first_word, end_word)."""

    def flush(shard, phrases):
        rows = list(_spans(shard, phrases))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "first_word", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        get, shard, held = phrases.symbol.get, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.array([get(w, OTHER) for w in text_words(text.as_py())], np.int32)
                for first in range(0, max(1, len(s)), size):  # a long text is cut, with an overlap that keeps every phrase whole
                    shard.append((doc, first, s[first : first + size + phrases.length - 1]))
                    held += len(shard[-1][2]) + 1
                    if held >= size:
                        yield flush(shard, phrases)
                        shard, held = [], 0
        if shard:
            yield flush(shard, phrases)

    return run


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, length: int = 12, most: int = MOST_WORDS, size: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Documents that hold passages of held-out items.

    Args:
        docs, doc, text: the corpus with its id and text columns.
        items, item, item_text: the held-out texts.
        length: words in a row that make a leak.
        most: words of items searched in one pass, about; more are searched
            in several passes over the corpus.
        size, piece: words in a shard, and in a piece of a long item.

    Returns:
        ``(doc_id, item_id, spans, words)``: for each document and item with
        at least one common run of ``length`` words, the number of merged
        spans and of words they hold. Null texts and ids are skipped, items
        shorter than ``length`` words leak nowhere; without any item or hit
        there are no rows. Texts of any length are searched whole.
    """
    spark = docs.sparkSession
    own = items.select(items[item].cast("bigint").alias("i"), items[item_text].alias("t")).where("i is not null and t is not null").distinct()
    own = Scratch(spark).save(own.mapInArrow(_pieces(length, piece), "i bigint, t array<string>, n bigint"))
    passes = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // most))
    corpus = docs.select(docs[doc].cast("bigint").alias("d"), docs[text].alias("t")).where("d is not null and t is not null")
    found = None
    for k in range(passes):
        part = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).select("i", "t").collect()  # about `most` words
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in part], length))
        spans = corpus.mapInArrow(_search(phrases, size), "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")
        found = spans if found is None else found.unionByName(spans)
    ordered = F.array_sort(F.collect_list(F.struct("first_word", "end_word")))
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("int").alias("spans"), F.lit(0).cast("bigint").alias("words"), F.lit(-1).cast("bigint").alias("end")),
        lambda a, x: F.struct(
            (a["spans"] + F.when(x["first_word"] > a["end"], 1).otherwise(0)).cast("int").alias("spans"),
            (a["words"] + F.greatest(F.lit(0).cast("bigint"), x["end_word"] - F.greatest(a["end"], x["first_word"]))).alias("words"),
            F.greatest(a["end"], x["end_word"]).alias("end"),
        ),
    )
    return found.groupBy("doc_id", "item_id").agg(merged.alias("m")).select("doc_id", "item_id", "m.spans", "m.words")
