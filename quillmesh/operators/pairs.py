"""Sums of products for every pair of records that shares a term, block by block: what is shuffled is records, not pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import blocks
from quillmesh.operators.evaluate import numbered
from quillmesh.session import Scratch

#: Blocks that few records are cut into, so that there are tasks enough, and records of such a block at least.
WIDE, LEAST = 8, 1024
#: Postings (row, term, w) of a block, one for each part.
Parts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _loaded(batches: Iterable[pa.RecordBatch], parts: int) -> dict[int, tuple[pa.Array, Parts]]:
    """By side, the ids of a block's records in their order and their postings by part."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return {}
    table, out = pa.Table.from_batches(rows), {}
    for side in np.unique(table["side"].to_numpy()):
        own = table.filter(pa.array(table["side"].to_numpy() == side)).sort_by("num")
        numbers = own["num"].to_numpy()
        order, first = np.unique(numbers, return_index=True)
        of: Parts = []
        for k in range(parts):
            t = own.filter(pa.array(own["part"].to_numpy() == k)).combine_chunks()
            n = t["terms"].combine_chunks().value_lengths().to_numpy() if len(t) else np.zeros(0, np.int64)
            terms, w = (t[c].combine_chunks().flatten().to_numpy() if len(t) else np.zeros(0, kind) for c, kind in (("terms", np.int32), ("ws", np.float64)))
            of.append((np.repeat(np.searchsorted(order, t["num"].to_numpy()), n), terms.astype(np.int64), w))
        out[int(side)] = own["rec_id"].combine_chunks().take(pa.array(first)), of
    return out


def _found(p: pa.Array, x: Parts, q: pa.Array, y: Parts, names: list[str], out: Callable[[int], slice] | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks that share a term; ``out`` has the rows of y that a row of x doesn't meet."""
    nx, ny = len(p), len(q)
    for of in zip(*(blocks.strips(u, v, nx, ny) for u, v in zip(x, y, strict=True)), strict=True):
        low, s = of[0][0], [v for _, v in of]
        shared = s[0] > 0
        for more in s[1:]:
            shared |= more > 0
        for i in range(len(shared)) if out else ():
            shared[i, out(low + i)] = False
        k, n = np.flatnonzero(shared), np.count_nonzero(shared, axis=1)
        if len(k):
            i = np.repeat(np.arange(len(shared)), n)
            yield pa.record_batch([p.take(pa.array(i + low)), q.take(pa.array(k - i * ny)), *(pa.array(v.reshape(-1)[k]) for v in s)], names=names)


def _meet(parts: int, directed: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two blocks' records to their pairs; one task has one pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _loaded(batches, parts)
        if not sides:
            return
        p, x = sides[0]
        q, y = sides.get(1, sides[0])
        has = lambda of: [(r, t, np.ones(len(w))) for r, t, w in of] if directed else of
        if 1 not in sides:  # a block with itself
            yield from _found(p, x, q, has(y), names, (lambda i: slice(i, i + 1)) if directed else lambda i: slice(i + 1))
            return
        yield from _found(p, x, q, has(y), names)
        if directed:
            yield from _found(q, y, p, has(x), names)

    return run


def _pairs(parts: dict[str, DataFrame], directed: bool, names: list[str], scratch: Scratch | None) -> DataFrame:
    """Every two blocks of records, in the order of their ids, meet in one task."""
    first = next(iter(parts.values()))
    scratch = scratch or Scratch(first.sparkSession)
    kind = first.schema["rec_id"].dataType.simpleString()
    rows = None
    for k, df in enumerate(parts.values()):
        own = df.select("rec_id", F.struct(F.lit(k).alias("part"), F.col("term").alias("term")).alias("term"), F.col("w").cast("double").alias("w")).where("w > 0 and rec_id is not null and term.term is not null")
        rows = own if rows is None else rows.unionByName(own)
    rows = scratch.save(rows)
    ids = scratch.save(numbered(rows.select(F.col("rec_id").alias("term")), scratch).select(F.col("term").alias("rec_id"), F.col("term_id").alias("num")))
    terms = numbered(rows, scratch).select("term", F.col("term_id").cast("int").alias("t"))
    own = rows.join(terms, "term").groupBy("rec_id", F.col("term.part").alias("part")).agg(F.collect_list(F.struct("t", "w")).alias("held"))
    n = max(1, ids.count())
    size = -(-n // max(1, -(-n // blocks.BLOCK), min(WIDE, n // LEAST)))
    g = -(-n // size)
    own = scratch.save(own.join(ids, "rec_id").select("rec_id", "num", "part", F.col("held.t").alias("terms"), F.col("held.w").alias("ws"), F.expr(f"cast(num div {size} as int)").alias("blk")))
    # the meetings of a block with itself, which have fewer pairs, come last
    at = lambda p, q, side: F.struct((F.expr(f"{g} - 1") - (q - p)).alias("far"), p.alias("p"), F.lit(side).alias("side"))
    x = F.transform(F.sequence(F.col("blk"), F.lit(g - 1)), lambda q: at(F.col("blk"), q, 0))
    y = F.when(F.col("blk") > 0, F.transform(F.sequence(F.lit(0), F.col("blk") - 1), lambda p: at(p, F.col("blk"), 1))).otherwise(F.array().cast("array<struct<far:int,p:int,side:int>>"))
    placed = own.select(F.explode(F.concat(x, y)).alias("at"), "rec_id", "num", "part", "terms", "ws").select(F.expr("cast(at.far * (at.far + 1) div 2 + at.p as int)").alias("task"), "at.side", "rec_id", "num", "part", "terms", "ws")
    placed = placed.repartitionById(g * (g + 1) // 2, F.col("task")).drop("task")
    return placed.mapInArrow(_meet(len(parts), directed, names), ", ".join([f"{names[0]} {kind}", f"{names[1]} {kind}", *(f"{c} double" for c in names[2:])]))


def sums(parts: dict[str, DataFrame], scratch: Scratch | None = None) -> DataFrame:
    """``(a, b, *parts)`` for a < b: the sum of products over shared terms of each part, ``(rec_id, term, w)`` with one row per record and term.

    Weights are above 0; rows of weight 0 are left out. Pairs that share a
    term in one part at least have a row, 0 where a part has none.
    """
    return _pairs(parts, False, ["a", "b", *parts], scratch)


def directed(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(x, y, score)``: the sum of x's weights over the terms that y has too, for each order of every pair that shares one; rows as for :func:`sums`."""
    return _pairs({"score": rows}, True, ["x", "y", "score"], scratch)
