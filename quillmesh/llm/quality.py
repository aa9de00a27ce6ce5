"""Problem 10: per-document text quality statistics and posterior text types.

Thresholds on a document's statistics are noisy labelling functions: each
votes for a text type or abstains. How often each vote falls on each type is
learned by expectation-maximization from the counts of vote patterns over all
documents, and a document gets the posterior of its pattern. The number of
patterns is bounded by the votes, not by the documents.
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
SPACE = re.compile(r"\s+")
BULLET = re.compile(r"^\s*(?:\d+[.)]|[-*+•#])", re.M)
STOP = re.compile(r"[.!?][\"'”»)]*(?=\s|$)")
CELL = re.compile(r"[|\t;]|</?t[dr]>|\s{3,}")
TYPES = ("prose", "list", "table", "junk")
#: Words in a window that is judged for itself.
SPAN = 32
#: Most common words; how often each follows each is a table of 34 MB then.
MOST_COMMON = 2048

STATS = (
    ("words", "bigint"), ("lines", "bigint"), ("chars", "bigint"), ("mean_word", "double"), ("symbols", "double"), ("digits", "double"),
    ("common", "double"), ("ended_lines", "double"), ("words_a_line", "double"), ("single", "double"), ("distinct", "double"),
    ("bullets", "double"), ("cells_a_line", "double"), ("stops", "bigint"),
)


def text_stats(text: str, common: dict[str, int]) -> tuple[tuple, np.ndarray]:
    """Statistics of a text in the order of ``STATS``, and its words as numbers of common words, 0 for others."""
    words = WORD.findall(text.lower())
    n, lines = len(words), [x for x in map(str.strip, text.split("\n")) if x]
    ids = np.array([common.get(w, 0) for w in words], np.int16)
    letters = sum(map(len, words))
    digits = sum(len(w) for w in words if w.isdigit())
    blank = len(text) - len(SPACE.sub("", text))
    k, m = max(1, n), max(1, len(lines))
    return (
        n, len(lines), len(text), letters / k, (len(text) - letters - blank) / len(text), digits / len(text),
        float((ids > 0).sum()) / k, sum(x[-1] in ".!?:;\"'”»)" for x in lines) / m, n / m, sum(len(w) == 1 for w in words) / k, len(set(words)) / k,
        len(BULLET.findall(text)) / m, len(CELL.findall(text)) / m, len(STOP.findall(text)),
    ), ids


def _measure(common, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows = [text_stats(t.as_py(), known) for t in part.column(1)]
                cols = [pa.array([r[0][k] for r in rows], pa.int64() if t == "bigint" else pa.float64()) for k, (_, t) in enumerate(STATS)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["doc_id", *(s for s, _ in STATS), "ids"])

    return run


def _follows(size: int):
    """Word numbers to counts of one number after another: at most size * size rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size * size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_py(), np.int16).astype(np.int64)
                np.add.at(seen, ids[:-1] * size + ids[1:], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    return run


def _order(size: int, weight):
    """Adds ``order``, the mean log ratio of a word number after the one before, and ``prose_share``, the share of words in windows that read like prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weight.value
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.int16).astype(np.int64) for x in batch.column(batch.num_columns - 1)]
            order, share = [], []
            for x in ids:
                if len(x) < 2:
                    order.append(0.0)
                    share.append(0.0)
                    continue
                w = table[x[:-1] * size + x[1:]]
                order.append(float(w.mean()))
                at = np.arange(0, len(x), SPAN)
                n = np.diff(np.r_[at, len(x)])
                usual = np.add.reduceat((x > 0).astype(float), at) / n
                fits = np.add.reduceat(np.r_[w, 0.0], at) / n
                share.append(float((n * ((usual >= 0.3) & (fits >= 0.25))).sum() / len(x)))
            keep = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(order, pa.float64()), pa.array(share, pa.float64())], names=[*batch.schema.names[:-1], "order", "prose_share"])

    return run


def votes() -> dict[str, F.Column]:
    """Labelling functions over the statistics: the number of a type in ``TYPES``, or -1 to abstain.

    A vote against prose that says nothing of the kind is the number of types.
    """
    c, other = F.col, len(TYPES)
    short = (c("lines") >= 3) & (c("words_a_line") < 6)
    pick = lambda *cases: F.coalesce(*(F.when(cond, F.lit(v)) for cond, v in cases), F.lit(-1))
    return {
        "usual": pick((c("common") >= 0.39, 0), (c("common") < 0.36, other)),
        "order": pick((c("order") >= 0.36, 0), (c("order") < 0.27, other)),
        "spans": pick((c("prose_share") >= 0.55, 0), (c("prose_share") < 0.45, other)),
        "shape": pick((c("cells_a_line") >= 1, 2), ((c("bullets") > 0.6) & short, 1), (short, other), (c("words_a_line") >= 8, 0)),
        "stops": pick(((c("stops") > 0) & (c("words") / F.greatest(c("stops"), F.lit(1)) < 6), 1), ((c("stops") > 0) & (c("words") / F.greatest(c("stops"), F.lit(1)) < 45), 0)),
        "letters": pick((c("single") >= 0.25, 3), (c("mean_word") > 12, 3), (c("words") == 0, 3), (c("mean_word") >= 3.5, 0)),
        "signs": pick((c("symbols") >= 0.2, 3), (c("symbols") + c("digits") >= 0.12, 2), (c("symbols") < 0.06, 0)),
        "variety": pick(((c("words") >= 20) & (c("distinct") < 0.12), 3), (c("distinct") > 0.95, other)),
    }


def learn(patterns: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each type for each vote pattern, by expectation-maximization.

    The start is a majority of the votes, in which a vote against prose counts
    for every other type. Counts are smoothed so that no vote is impossible.
    """
    k, f = len(TYPES), patterns.shape[1]
    post = np.full((len(patterns), k), 0.5)
    for j in range(f):
        for v in range(k):
            post[patterns[:, j] == v, v] += 2.0
        post[patterns[:, j] == k, 1:] += 1.5
    post = post**3
    post /= post.sum(axis=1, keepdims=True)
    onehot = np.stack([patterns == v for v in range(-1, k + 1)], axis=2).astype(float)  # patterns, functions, votes
    for _ in range(rounds):
        weight = post * count[:, None]
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + k)
        table = np.einsum("pk,pfv->kfv", weight, onehot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logp = np.log(prior) + np.einsum("pfv,kfv->pk", onehot, np.log(table))
        new = np.exp(logp - logp.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-6:
            break
    return post


def text_quality(docs: DataFrame, doc: str, text: str, common_words: DataFrame, word: str) -> DataFrame:
    """Statistics, labelling votes and posterior text type of every text.

    Args:
        docs, doc, text: the corpus with its id and text columns.
        common_words, word: the common words of all languages; more than
            ``MOST_COMMON`` different ones are an error.

    Returns:
        ``doc_id``, the columns of ``STATS``, ``order`` and ``prose_share``
        (how well common words follow each other, and the share of words in
        windows that read like prose), ``p_prose``, ``p_list``, ``p_table``,
        ``p_junk`` and ``type``, the likeliest. Null and blank texts and null
        ids have no row. Whole texts are measured.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = common_words.select(F.lower(common_words[word]).alias("w")).where("w is not null").distinct().orderBy("w").limit(MOST_COMMON + 1).collect()
    if len(known) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    size = len(known) + 1
    common = spark.sparkContext.broadcast({r[0]: k + 1 for k, r in enumerate(known)})
    fields = "doc_id bigint, " + ", ".join(f"{s} {t}" for s, t in STATS)
    rows = docs.select(docs[doc].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null").where(F.col("text").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
    measured = scratch.save(rows.mapInArrow(_measure(common, size), fields + ", ids binary"))
    pairs = measured.select("ids").mapInArrow(_follows(size), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(size * size)
    seen[pairs.column(0).to_numpy()] = pairs.column(1).to_numpy()
    square = seen.reshape(size, size)
    free = square.sum(axis=1, keepdims=True) * square.sum(axis=0, keepdims=True) / max(1.0, seen.sum())
    weight = spark.sparkContext.broadcast(np.log((square + 0.5) / (free + 0.5)).ravel())
    own = votes()
    ordered = measured.mapInArrow(_order(size, weight), fields + ", order double, prose_share double")
    voted = scratch.save(ordered.withColumns({f"v_{k}": v for k, v in own.items()}))
    names = [f"v_{k}" for k in own]
    found = voted.groupBy(*names).count().toArrow()  # one row per pattern of votes
    if found.num_rows:
        patterns = np.stack([found.column(c).to_numpy() for c in names], axis=1)
        post = learn(patterns, found.column("count").to_numpy().astype(float))
        rows_p = [(*map(int, p), *map(float, q)) for p, q in zip(patterns, post, strict=True)]
    else:
        rows_p = []
    kinds = spark.createDataFrame(rows_p, ", ".join(f"{c} int" for c in names) + ", " + ", ".join(f"p_{t} double" for t in TYPES))
    best = F.greatest(*(F.col(f"p_{t}") for t in TYPES))
    return (
        voted.join(kinds, names)
        .withColumn("type", F.coalesce(*(F.when(F.col(f"p_{t}") == best, t) for t in TYPES)))
        .select("doc_id", *(s for s, _ in STATS), "order", "prose_share", *(f"p_{t}" for t in TYPES), "type")
    )
