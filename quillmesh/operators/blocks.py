"""Pairs of records above a threshold, from products of sparse vectors block by block: pairs below it are never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.components import SLACK

#: Records of a block, on average; every two blocks meet in one task.
BLOCK = 8192
#: Rows of a block that are multiplied at once, and terms at most that are multiplied as a dense matrix: those of so large a part of a block that this costs less than their single products.
ROWS, DENSE, PART = 64, 256, 0.05
#: Digits of a score; sums that differ by their order only are ties.
DIGITS = 12


def strips(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], nx: int, ny: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of x, sums with all rows of y), a few rows of x at a time; x and y are (row, term, w), x in order of rows."""
    both = np.intersect1d(x[1], y[1])
    x, y = ((r[k], np.searchsorted(both, t[k]), w[k]) for r, t, w in (x, y) for k in (np.isin(t, both),))
    df = np.bincount(y[1], minlength=len(both))
    rank = np.empty(len(both), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(both))
    (xr, xt, xw), (yr, yt, yw) = ((r, rank[t], w) for r, t, w in (x, y))
    dense = min(DENSE, int((df > PART * ny).sum()))
    one, two = np.zeros((nx, dense)), np.zeros((ny, dense))
    for m, r, t, w in ((one, xr, xt, xw), (two, yr, yt, yw)):
        m[r[t < dense], t[t < dense]] = w[t < dense]
    rare = yt >= dense
    order = np.argsort(yt[rare], kind="stable")
    yr, yw, first = yr[rare][order], yw[rare][order], np.searchsorted(yt[rare][order], np.arange(len(both) + 1))
    xr, xt, xw = xr[xt >= dense], xt[xt >= dense], xw[xt >= dense]
    step = max(1, ROWS * BLOCK // max(ny, BLOCK))
    for low in range(0, nx, step):
        s = one[low : low + step] @ two.T
        k = slice(*np.searchsorted(xr, (low, low + step)))
        n = first[xt[k] + 1] - first[xt[k]]
        at = np.repeat(first[xt[k]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(s.reshape(-1), np.repeat((xr[k] - low) * ny, n) + yr[at], np.repeat(xw[k], n) * yw[at])
        yield low, s


def products(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], nx: int, ny: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, sums) of ``least`` or more, a few rows of x at a time; x and y as for :func:`strips`."""
    for low, s in strips(x, y, nx, ny):
        k = np.flatnonzero(s >= least - SLACK)
        i, j = np.divmod(k, ny)
        s = np.round(s.reshape(-1)[k], DIGITS)
        keep = s >= least
        yield i[keep] + low, j[keep], s[keep]


def _meet(least: float) -> Callable[[pa.Table], pa.Table]:
    """Two blocks' rows to their pairs."""

    def run(rows: pa.Table) -> pa.Table:
        of = []
        for side in (0, 1):
            t = rows.filter(pa.array(rows["side"].to_numpy() == side)).combine_chunks()
            ids, own = t["rec_id"].to_numpy(), t["own"].to_numpy()
            n = t["terms"].combine_chunks().value_lengths().to_numpy() if len(t) else np.zeros(0, np.int64)
            terms, w = (t[c].combine_chunks().flatten().to_numpy() if len(t) else np.zeros(0, k) for c, k in (("terms", np.int64), ("ws", np.float64)))
            of.append((ids, own, (np.repeat(np.arange(len(ids)), n), terms, w)))
        (p, _, x), (q, own, y) = of
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j, s in products(x, y, len(p), len(q), least) if len(p) and len(q) else ():
            keep = (p[i] != q[j]) & ~(own[j] & (p[i] > q[j]))
            for to, v in zip(found, (p[i][keep], q[j][keep], s[keep]), strict=True):
                to.append(v)
        a, b, s = (np.concatenate(v) for v in found)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "s": s})

    return run


def above(rows: DataFrame, least: float, of: DataFrame | None = None) -> DataFrame:
    """``(a, b, s)`` for a < b: pairs whose sum of products over shared terms is ``least`` or more.

    Args:
        rows: saved ``(rec_id, term, w)``, term a number, one row per record
            and term.
        least: above 0.
        of: ``(rec_id)``; only pairs of which one record at least is among
            these are made.

    Every two blocks of records meet in one task, so a record's terms are
    copied once for each block; what is shuffled is these copies, not pairs.
    """
    if least <= 0:
        raise ValueError("the least sum must be above 0; every pair would do")
    spark = rows.sparkSession
    own = rows.groupBy("rec_id").agg(F.collect_list(F.struct("term", "w")).alias("t")).select("rec_id", F.col("t.term").alias("terms"), F.col("t.w").alias("ws"))
    count = lambda df: -(-max(1, df.select("rec_id").distinct().count()) // BLOCK)
    g = count(rows)
    block = lambda n: F.pmod(F.xxhash64("rec_id"), F.lit(n)).cast("int")
    place = lambda p, q, side, mine: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).alias("side"), mine.alias("own"))
    if of is None:
        k = g * (g + 1) // 2
        own = own.withColumn("blk", block(g))
        x = F.transform(F.sequence(F.col("blk"), F.lit(g - 1)), lambda q: place(F.col("blk"), q, 0, F.lit(False)))
        y = F.transform(F.sequence(F.lit(0), F.col("blk")), lambda p: place(p, F.col("blk"), 1, p == F.col("blk")))
        placed = own.select(F.explode(F.concat(x, y)).alias("at"), "rec_id", "terms", "ws")
    else:
        h = count(of)
        k = g * h
        marked = own.join(of.select("rec_id").distinct().withColumn("mine", F.lit(True)), "rec_id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
        x = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda q: place(block(h), q, 0, F.lit(False)))
        y = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda p: place(p, block(g), 1, F.col("mine")))
        placed = marked.select(F.explode(F.when(F.col("mine"), F.concat(x, y)).otherwise(y)).alias("at"), "rec_id", "terms", "ws")
    placed = placed.select("at.*", "rec_id", "terms", "ws").repartition(max(2 * k, spark.sparkContext.defaultParallelism), "p", "q")
    return placed.groupBy("p", "q").applyInArrow(_meet(least), "a bigint, b bigint, s double")
