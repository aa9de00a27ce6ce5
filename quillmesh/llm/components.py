"""Problem 2: consolidating pairwise matches into groups by random contraction.

Each round every vertex hooks to the neighbour (or itself) that comes first in
a fresh hash order, the edges are relabelled to the hooks and deduplicated, and
the graph shrinks by a constant factor in expectation whatever its shape. The
hook tables shrink with it, so composing them backwards costs one pass over
the vertices in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import Scratch


def _order(seed: int, v: Column) -> Column:
    """Rank of a vertex in the hash order of a round; the id breaks ties."""
    return F.struct(F.xxhash64(v, F.lit(seed)).alias("h"), v.alias("v"))


def contract(edges: DataFrame, left: str, right: str, scratch: Scratch | None = None, seed: int = 17) -> DataFrame:
    """Group identifier of every record that is linked to another.

    Args:
        edges: pairs of ids; other columns are ignored whatever their names.
        left, right: the id columns.
        scratch: tables of the rounds go here.
        seed: start of the hash orders; the groups don't depend on it.

    Returns:
        ``(group_id, id)``: one row for each id linked to a different id, the
        smallest id of its group first. Pairs with a null end and self-pairs
        link nothing; repeats and direction don't matter; no edges give no
        rows.

    The hub of a star needs no task of its own: hooks are minima, combined
    before the shuffle, and AQE splits a hub's rows in the two joins.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    a, b = edges[left].cast("bigint"), edges[right].cast("bigint")
    e = scratch.save(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(a.isNotNull() & b.isNotNull() & (a != b))
        .distinct()
    )
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        s = seed + len(hooks)
        arcs = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("x")).select("x.*")
        hook = scratch.save(
            arcs.groupBy("v")
            .agg(F.min(_order(s, F.col("n"))).alias("m"))
            .select("v", F.least(F.col("m"), _order(s, F.col("v")))["v"].alias("r"))
        )
        x = F.col("x.r"), F.col("y.r")
        nxt = scratch.save(
            e.join(hook.alias("x"), F.col("a") == F.col("x.v"))
            .join(hook.alias("y"), F.col("b") == F.col("y.v"))
            .where(x[0] != x[1])
            .select(F.least(*x).alias("a"), F.greatest(*x).alias("b"))
            .distinct()
        )
        scratch.drop(e)
        hooks.append(hook)
        e = nxt
    if not hooks:
        return e.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    root = hooks[-1]
    for hook in reversed(hooks[:-1]):
        up = root.select(F.col("v").alias("k"), F.col("r").alias("top"))
        root = hook.join(up, F.col("r") == F.col("k"), "left").select("v", F.coalesce("top", "r").alias("r"))
    root = scratch.save(root)
    low = root.groupBy("r").agg(F.min("v").alias("group_id"))
    return root.join(low, "r").select("group_id", F.col("v").alias("id"))
