"""Problem 5: the same or nearly the same records across splits, by winnowing.

A text is read as the hashes of its words. Of every window of rolling hashes
the least is selected; this is done for the words as written and for the
distinct words in a fixed order, which seeds texts whose words were moved.
Short texts, in which a few edits may spoil every window, are also seeded by
the rarest words, one of which any two texts that overlap enough share.
Records of different splits meet where they select the same fingerprint, under
a lossless bound on the difference of their word sets. The fingerprints that a
pair shares are chained collinearly and extended, which gives the coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.neardup import word_hashes
from quillmesh.llm.setjoin import HOT, _mix, as_pairs, found_pairs, frequencies, hot_pairs, in_chunks, prefixes, sketches, whole_groups, with_frequencies
from quillmesh.session import Scratch, tasks

GRAM, WINDOW = 5, 4
#: Distinct words below which a text finds its like by its rarest words too.
SHORT = 24
#: Bits of a class's flags.
TRAIN, HELD = 1, 2


def winnow(flat: np.ndarray, n: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected fingerprints of many texts laid end to end.

    Returns text number, position of the first word, and fingerprint. A text
    with fewer words than a gram gives none; one with fewer grams than a
    window gives its least.
    """
    x = flat.view(np.uint64)
    ends = np.cumsum(n)
    if len(x) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(x) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x100000001B3) + x[k : k + len(h)]
    h = _mix(h)
    text = np.repeat(np.arange(len(n)), n)[: len(h)]
    pos = np.arange(len(h)) - (ends - n)[text]
    grams = n[text] - gram + 1  # of the text
    h = np.where(pos < grams, h, ~np.uint64(0))
    wide = np.concatenate([h, np.full(window, ~np.uint64(0))])
    view = np.lib.stride_tricks.sliding_window_view(wide, window)[: len(h)]
    # a window that would run over its text's end starts at the last place where it fits
    start = np.flatnonzero(((pos <= grams - window) | (pos == 0)) & (pos < grams))
    inside = np.minimum(grams[start], window)
    masked = np.where(np.arange(window) < inside[:, None], view[start], ~np.uint64(0))
    picked = np.unique(start + (window - 1 - masked[:, ::-1].argmin(axis=1)))
    picked = picked[pos[picked] < grams[picked]]
    return text[picked], pos[picked], h[picked].view(np.int64)


def _seeds(heavy, num: int, den: int, hot: int, hot_only: bool):
    """Classes (cid, tokens[, df], side, words) to rows (key, hot, cid, n, side, s0, s1), or to the keys of the hot ones alone.

    A fingerprint can only be shared by ``hot`` classes if each of its words
    is; such keys are marked, since they may have to be cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                last = part.num_columns - 1
                tokens, df, n = frequencies(part, 1, heavy)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((tokens, row))
                tokens, df = tokens[order], df[order]
                keys, rows, marked = [], [], []
                for flat, size, often in (
                    (part.column(last).flatten().to_numpy(), part.column(last).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), None),
                    (tokens, n, df),
                ):
                    if heavy is not None and often is None:
                        known, count = heavy.value
                        often = np.zeros(len(flat), np.int64)
                        if len(known):
                            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                            often = np.where(known[at] == flat, count[at], 0)
                    least = np.full(len(flat), hot)  # of the words of the gram at each place
                    if often is not None:
                        least = np.r_[np.min([often[k : len(often) - GRAM + 1 + k] for k in range(GRAM)], axis=0), np.zeros(min(len(flat), GRAM - 1), np.int64)] if len(flat) >= GRAM else np.zeros(len(flat), np.int64)
                    which = np.arange(len(size))
                    if hot_only:  # texts without a hot gram give none
                        which = np.unique(np.repeat(which, size)[least >= hot])
                        own = np.repeat(np.isin(np.arange(len(size)), which), size)
                        flat, least, size = flat[own], least[own], size[which]
                    text, pos, fp = winnow(flat, size)
                    keys.append(fp)
                    rows.append(which[text])
                    marked.append(least[(np.cumsum(size) - size)[text] + pos] >= hot)
                tokens, df, row, pos, prefix = prefixes(tokens, df, n, num, den)
                brief = (n * num < SHORT * den)[row]  # whatever overlaps with a short text enough
                single = brief & (pos < prefix[row]) & (df < hot)
                key, at = hot_pairs(tokens, row, brief & (pos < prefix[row] + 1) & (df >= hot), len(n))
                keys += [_mix(tokens[single].view(np.uint64) + np.uint64(11)).view(np.int64), key]
                rows += [row[single], at]
                marked += [np.zeros(int(single.sum()), bool), np.ones(len(key), bool)]
                at, key, hot_key = map(np.concatenate, (rows, keys, marked))
                if hot_only:
                    at, key = at[hot_key], key[hot_key]
                order = np.lexsort((key, at))
                at, key = at[order], key[order]
                fresh = np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])][: len(at)]
                at, key = at[fresh], key[fresh]
                if hot_only:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                    continue
                hot_key = hot_key[order][fresh]
                sk = sketches(tokens, row, len(n), 128)
                cid, side = part.column(0).to_numpy()[at], part.column(last - 1).to_numpy()[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(hot_key), pa.array(cid), pa.array(n[at].astype(np.int32)), pa.array(side), *(pa.array(sk[at, k].view(np.int64)) for k in (0, 1))],
                    names=["key", "hot", "cid", "n", "side", "s0", "s1"],
                )

    return run


def _meet(num: int, den: int):
    """Seeds (key, cid, n, side, s0, s1) sorted by (key, n) to candidate pairs (a, b), a < b, of different splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, 100_000):
            first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            size = np.diff(np.r_[first, len(cols[0])])
            both = (size > 1) & (np.bitwise_or.reduceat(cols[3], first) == TRAIN | HELD)
            keep = np.repeat(both, size)
            key, cid, n, side, *planes = (x[keep] for x in cols)
            if not len(key):
                continue
            i, j = found_pairs(key, cid, n, planes, num, den)
            across = ((side[i] & TRAIN > 0) & (side[j] & HELD > 0)) | ((side[i] & HELD > 0) & (side[j] & TRAIN > 0))
            yield as_pairs(cid[i[across]], cid[j[across]])

    return run


def chain(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Collinear seeds of two texts, extended: runs (start in a, start in b, words).

    The longest chain of seeds that ascends in both texts is merged on its
    diagonals, and each run is extended over equal words both ways.
    """
    seeds = sorted(seeds)
    tails: list[int] = []
    at_tail: list[int] = []
    back = [-1] * len(seeds)
    for s, (_, q) in enumerate(seeds):  # longest increasing chain in b, a ascends already
        k = bisect_left(tails, q)
        back[s] = at_tail[k - 1] if k else -1
        tails[k : k + 1] = [q]
        at_tail[k : k + 1] = [s]
    kept = []
    s = at_tail[-1] if at_tail else -1
    while s >= 0:
        kept.append(seeds[s])
        s = back[s]
    runs: list[list[int]] = []
    for p, q in reversed(kept):
        while runs and runs[-1][0] + runs[-1][2] < p and runs[-1][1] + runs[-1][2] < q and a[runs[-1][0] + runs[-1][2]] == b[runs[-1][1] + runs[-1][2]]:
            runs[-1][2] += 1
        low = (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) if runs else (0, 0)
        if runs and p - q == runs[-1][0] - runs[-1][1] and p <= low[0]:
            runs[-1][2] = max(runs[-1][2], p + gram - runs[-1][0])
            continue
        cut = max(0, low[0] - p, low[1] - q)  # words that the run before has already
        if cut < gram:
            run = [p + cut, q + cut, gram - cut]
            while not cut and run[0] > low[0] and run[1] > low[1] and a[run[0] - 1] == b[run[1] - 1]:
                run = [run[0] - 1, run[1] - 1, run[2] + 1]
            runs.append(run)
    if runs:
        last = runs[-1]
        while last[0] + last[2] < len(a) and last[1] + last[2] < len(b) and a[last[0] + last[2]] == b[last[1] + last[2]]:
            last[2] += 1
    return [tuple(x) for x in runs]


def shared_seeds(a: list[np.ndarray], b: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each pair of texts the places of the fingerprints that both select, of those that are alone in either."""
    at: list[list[dict[int, int]]] = []
    for texts in (a, b):
        own: list[dict[int, int]] = [{} for _ in texts]
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        for t, p, f in zip(*(x.tolist() for x in winnow(flat, np.array([len(x) for x in texts], np.int64))), strict=True):
            own[t][f] = -1 if f in own[t] else p
        at.append(own)
    return [[(p, y[f]) for f, p in x.items() if p >= 0 and y.get(f, -1) >= 0] for x, y in zip(*at, strict=True)]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, words a, words b, shared, either) to (a, b, shared, either, seeds, covered): words of b covered by the chain."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            wa, wb = ([x.values.to_numpy() for x in part.column(k)] for k in (2, 3))
            runs = [chain(x, y, s) for x, y, s in zip(wa, wb, shared_seeds(wa, wb), strict=True)]
            covered = [sum(r[2] for r in x) / max(1, len(y)) for x, y in zip(runs, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 4, 5)), pa.array([len(x) for x in runs], pa.int32()), pa.array(covered, pa.float64())], names=["a", "b", "shared", "either", "runs", "covered"])


def cross_split(rows: DataFrame, record: str, text: Column, flags: DataFrame, num: int = 7, den: int = 10, least: int = 10, hot: int = HOT) -> DataFrame:
    """Pairs of a training and a held-out record with the same or nearly the same text.

    Args:
        rows: the records; repeated rows count once.
        flags: ``(id, train, held)``; a record may be both, null is false.
        num, den: the least overlap of the two sets of words, as a fraction.
        least: texts with fewer distinct words are left out.
        hot: see below.

    Returns:
        ``(train_id, held_id, shared, either, runs, covered)``, with the size
        of both sets' intersection and union, the number of chained runs, and
        the share of the held-out record's words that they cover. A record
        isn't paired with itself; two that are both train and held-out come
        in either order. Pairs of which a text has fewer than ``SHORT``
        distinct words are all found; of the others those are found that
        select a common fingerprint, as written or in the order of the words.

    Equal texts are one class until the end, so a group of copies costs no
    more than its own pairs. A seed shared by ``hot`` classes is cut into
    chunks that meet pairwise.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    own = scratch.save(
        rows.select(rows[record].cast("bigint").alias("id"), text.alias("t"))
        .where("id is not null and t is not null")
        .join(flags.select("id", "train", "held"), "id")
        .where("train or held")
        .select("id", F.coalesce("train", F.lit(False)).alias("train"), F.coalesce("held", F.lit(False)).alias("held"), word_hashes(F.col("t")).alias("words"))
        .select("*", F.sort_array(F.array_distinct("words")).alias("tokens"), *(F.xxhash64(F.lit(k), F.col("words")).alias(f"d{k}") for k in (1, 2)))
        .where(F.size("tokens") >= least)
    )
    side = F.max(F.col("train").cast("int")) * TRAIN + F.max(F.col("held").cast("int")) * HELD
    # numbered, since an id may come with several texts; the numbers hold once they are written
    classes = scratch.save(own.groupBy("d1", "d2").agg(side.alias("side"), F.first("words").alias("words"), F.first("tokens").alias("tokens")).withColumn("cid", F.monotonically_increasing_id()))
    members = scratch.save(own.select("id", "train", "held", "d1", "d2").join(classes.select("d1", "d2", "cid"), ["d1", "d2"]).select("id", "cid", "train", "held").distinct())
    scratch.drop(own)
    source, heavy, any_hot = with_frequencies(classes.select("cid", "tokens", "side", "words"), "cid", "tokens", hot, scratch)
    seeds = source.mapInArrow(_seeds(heavy, num, den, hot, False), "key bigint, hot boolean, cid bigint, n int, side int, s0 bigint, s1 bigint")
    if any_hot:
        often = scratch.save(source.mapInArrow(_seeds(heavy, num, den, hot, True), "key bigint").groupBy("key").count().where(F.col("count") >= hot))
        seeds = in_chunks(seeds, often, "cid", hot, scratch) if not often.isEmpty() else seeds
    met = seeds.drop("hot").repartition(tasks(spark), "key").sortWithinPartitions("key", "n").mapInArrow(_meet(num, den), "a bigint, b bigint").distinct()
    found = met.unionByName(classes.where(F.col("side") == TRAIN | HELD).select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    x, y = classes.alias("x"), classes.alias("y")
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    is_train, is_held = (lambda c, bit=bit: F.col(c).bitwiseAND(bit) > 0 for bit in (TRAIN, HELD))
    entry = lambda p, q, u, v: F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(u).alias("wa"), F.col(v).alias("wb"))
    ways = F.array_compact(
        F.array(
            F.when(is_train("sa") & is_held("sb"), entry("a", "b", "wx", "wy")),
            F.when((F.col("a") != F.col("b")) & is_train("sb") & is_held("sa"), entry("b", "a", "wy", "wx")),
        )
    )
    exact = (
        found.join(x, F.col("a") == F.col("x.cid"))
        .join(y, F.col("b") == F.col("y.cid"))
        .select("a", "b", F.col("x.side").alias("sa"), F.col("y.side").alias("sb"), F.col("x.words").alias("wx"), F.col("y.words").alias("wy"), shared.alias("shared"), (F.size("x.tokens") + F.size("y.tokens") - shared).alias("either"))
        .where(F.col("shared") * den >= F.col("either") * num)
        .select(F.explode(ways).alias("w"), "shared", "either")
        .select("w.*", "shared", "either")
        .mapInArrow(_aligned, "a bigint, b bigint, shared int, either int, runs int, covered double")
    )
    train = members.where("train").select(F.col("cid").alias("a"), F.col("id").alias("train_id"))
    held = members.where("held").select(F.col("cid").alias("b"), F.col("id").alias("held_id"))
    return exact.join(train, "a").join(held, "b").where("train_id <> held_id").select("train_id", "held_id", "shared", "either", "runs", "covered")
