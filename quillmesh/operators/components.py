"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import Scratch

#: Slack of a bound on sums of doubles.
SLACK = 1e-9


def connected(edges: DataFrame, left: str = "a", right: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``(rec_id, component)`` of every id on an edge; the component is its smallest id.

    Each round hangs every vertex's larger neighbours on its smallest one, then
    its smaller ones, until only stars are left. Null ends are left out, and a
    vertex whose only edge leads to itself is its own component.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    own = edges.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v")).where("u is not null and v is not null")
    alone = own.where("u = v").select(F.col("u").alias("rec_id"))
    e = scratch.save(own.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = scratch.save(small)
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if now == size:
            break
        size = now
    stars = e.select(F.col("u").alias("rec_id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("rec_id"), "component").distinct()).unionByName(alone.select("rec_id", F.col("rec_id").alias("component"))).groupBy("rec_id").agg(F.min("component").alias("component"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(rec_id, cluster)``: two clusterings joined where their clusters share a record."""
    both = one.select("rec_id", F.concat(F.lit("a"), "cluster").alias("k")).unionByName(other.select("rec_id", F.concat(F.lit("b"), "cluster").alias("k")))
    first = both.groupBy("k").agg(F.min("rec_id").alias("a"))
    return connected(both.join(first, "k").select("a", F.col("rec_id").alias("b"))).select("rec_id", F.col("component").alias("cluster"))


def foreign(rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``most``: the largest ``w`` that another component has under the same ``on``; rows where no other has any are left out.

    ``rows`` is ``(*on, component, w, ...)``.
    """
    top = rows.groupBy(*on, "component").agg(F.max("w").alias("w"))
    first = top.groupBy(*on).agg(F.max(F.struct("w", "component")).alias("one"))
    second = top.join(first, on).where(F.col("component") != F.col("one.component")).groupBy(*on).agg(F.max("w").alias("two"))
    both = first.join(second, on)
    return rows.join(both, on).withColumn("most", F.when(F.col("component") == F.col("one.component"), F.col("two")).otherwise(F.col("one.w"))).drop("one", "two")


def across(rows: DataFrame, part: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``(a, b, p, q)``: pairs of two components p and q whose sum of products over shared terms is ``least`` or more.

    ``rows`` is ``(rec_id, term, w)``, saved, maybe with a column ``part`` that
    a pair must share; ``part`` is ``(rec_id, component)``, and a record that it
    lacks is its own component. As in ``index.at_least`` only a record's heads
    are joined, here against the largest weights of other components. One
    record of a pair is outside the largest component, so that one never meets
    itself.
    """
    on = ["part", "term"] if "part" in rows.columns else ["term"]
    rec = [*on[:-1], "rec_id"]
    own = rows.join(part, "rec_id", "left").withColumn("component", F.coalesce("component", "rec_id"))
    own = scratch.save(foreign(scratch.save(own), on).join(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("df")), on))
    upto = Window.partitionBy(*rec).orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = scratch.save(own.withColumn("upto", F.sum(F.col("w") * F.col("most")).over(upto)).where(F.col("upto") >= least - SLACK).select(*on, "rec_id", "component"))
    largest = part.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    small = heads if largest is None else heads.where(F.col("component") != largest["component"])
    x, y = small.select(*on, F.col("rec_id").alias("x"), F.col("component").alias("p")), heads.select(*on, F.col("rec_id").alias("y"), F.col("component").alias("q"))
    pairs = x.join(y, on).where("p <> q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("p")).otherwise(F.col("q")).alias("p"), F.when(F.col("x") < F.col("y"), F.col("q")).otherwise(F.col("p")).alias("q")).distinct()
    once = own.select("rec_id", "term", "w").distinct() if len(on) > 1 else own.select("rec_id", "term", "w")
    u, v = (once.select(F.col("rec_id").alias(k), "term", F.col("w").alias(w)) for k, w in (("a", "u"), ("b", "v")))
    return pairs.join(u, "a").join(v, ["b", "term"]).groupBy("a", "b", "p", "q").agg(F.sum(F.col("u") * F.col("v")).alias("s")).where(F.col("s") >= least).select("a", "b", "p", "q")


def over_terms(rows: DataFrame, least: float, within: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(rec_id, component)`` of the records that are linked, the pairs of which need not be made.

    Args:
        rows: ``(rec_id, term, w)``, weights not below 0. Two records are
            linked if their sum of products over shared terms is ``least`` or
            more.
        least: above 0.
        within: ``(rec_id, part)``; only records that share a part are linked.

    Two weights of one term whose product suffices both suffice with the term's
    largest weight, so such links are a star for each term. What links records
    by several terms only is looked for between the components of these stars.
    """
    if least <= 0:
        raise ValueError("the least sum must be above 0; every pair would do")
    scratch = scratch or Scratch(rows.sparkSession)
    own = rows.where("w > 0 and rec_id is not null").select(F.col("rec_id").cast("bigint").alias("rec_id"), "term", "w")
    on = ["term"]
    if within is not None:
        own, on = own.join(within.select("rec_id", "part").distinct(), "rec_id"), ["part", "term"]
    own = scratch.save(own)
    top = own.groupBy(*on).agg(F.max(F.struct("w", "rec_id")).alias("top"))
    star = own.join(top, on).where((F.col("w") * F.col("top.w") >= least) & (F.col("rec_id") != F.col("top.rec_id")))
    part = scratch.save(connected(star.select(F.col("rec_id").alias("a"), F.col("top.rec_id").alias("b")), scratch=scratch))
    more = scratch.save(across(own, part, least, scratch))
    if more.isEmpty():
        return part
    return connected(part.select(F.col("rec_id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")), scratch=scratch)
