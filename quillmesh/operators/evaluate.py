"""Accuracy of a clustering against labels, from one contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import Scratch


def _half(c: Column) -> Column:
    return c * (c - 1) / 2


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


class Contingency:
    """Counts of records by experimental cluster and gold label.

    ``experimental`` is ``(rec_id, cluster)`` and ``gold`` ``(rec_id, label)``,
    both with one row per record; records in only one of them are left out.
    The counts are written once, since every figure reads them.
    """

    def __init__(self, experimental: DataFrame, gold: DataFrame, scratch: Scratch | None = None):
        scratch = scratch or Scratch(experimental.sparkSession)
        e, g = experimental.select("rec_id", F.col("cluster").alias("e")), gold.select("rec_id", F.col("label").alias("g"))
        self.cells = scratch.save(e.join(g, "rec_id").groupBy("e", "g").agg(F.count(F.lit(1)).alias("n")))
        self.rows = self.cells.groupBy("e").agg(F.sum("n").alias("ne"))
        self.cols = self.cells.groupBy("g").agg(F.sum("n").alias("ng"))

    def pairwise(self) -> DataFrame:
        """One row ``(precision, recall, f1)`` over unordered pairs; 0 where there are none."""
        both = self.cells.agg(F.coalesce(F.sum(_half(F.col("n"))), F.lit(0.0)).alias("hit"))
        e = self.rows.agg(F.coalesce(F.sum(_half(F.col("ne"))), F.lit(0.0)).alias("pe"))
        g = self.cols.agg(F.coalesce(F.sum(_half(F.col("ng"))), F.lit(0.0)).alias("pg"))
        one = both.join(F.broadcast(e)).join(F.broadcast(g))  # single rows
        return one.select(_ratio(F.col("hit"), F.col("pe")).alias("precision"), _ratio(F.col("hit"), F.col("pg")).alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))

    def exact(self) -> DataFrame:
        """One row ``(cluster_precision, cluster_recall, cluster_f1)``: clusters that are exactly a gold one."""
        same = self.cells.join(self.rows, "e").join(self.cols, "g").where("n = ne and n = ng").agg(F.count(F.lit(1)).alias("hit"))
        one = same.join(F.broadcast(self.rows.agg(F.count(F.lit(1)).alias("ke")))).join(F.broadcast(self.cols.agg(F.count(F.lit(1)).alias("kg"))))
        return one.select(_ratio(F.col("hit"), F.col("ke")).alias("cluster_precision"), _ratio(F.col("hit"), F.col("kg")).alias("cluster_recall")).withColumn("cluster_f1", _f1(F.col("cluster_precision"), F.col("cluster_recall")))

    def variation(self) -> DataFrame:
        """One row ``(vi)``: H(E) + H(G) - 2 I(E, G), natural logarithms; 0 without records."""
        n = self.rows.agg(F.sum("ne").alias("total"))
        part = self.cells.join(self.rows, "e").join(self.cols, "g").join(F.broadcast(n))
        p = F.col("n") / F.col("total")
        return part.agg(F.coalesce(F.sum(p * (F.ln(F.col("ne") / F.col("n")) + F.ln(F.col("ng") / F.col("n")))), F.lit(0.0)).alias("vi"))

    def report(self) -> DataFrame:
        """One row with all seven figures."""
        return self.pairwise().join(F.broadcast(self.exact())).join(F.broadcast(self.variation()))  # single rows


def running_total(rows: DataFrame, order: list[Column], value: str, out: str, scratch: Scratch | None = None) -> DataFrame:
    """Running sum of one column, see :func:`running_totals`."""
    return running_totals(rows, order, {out: value}, scratch)


def running_totals(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """Running sums ``{out: value}`` over all rows in a total order, without gathering them in one task.

    Rows are range-partitioned once; sums of the partitions give each its start.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    ranged = scratch.save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = {out: f"start_{k}" for k, out in enumerate(sums)}
    start = ranged.groupBy("part").agg(*(F.sum(v).alias(starts[out]) for out, v in sums.items())).select("part", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in starts.values()))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({out: F.sum(v).over(inside) for out, v in sums.items()}).join(F.broadcast(start), "part")  # one row per partition
    return own.withColumns({out: F.col(out) + F.col(s) for out, s in starts.items()}).drop("part", *starts.values())


def numbered(terms: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(term, term_id)``: each distinct term of a table with its number from 0 in the order of terms; null isn't one."""
    own = terms.select("term").where("term is not null").distinct().withColumn("one", F.lit(1).cast("bigint"))
    return running_total(own, [F.col("term")], "one", "k", scratch).select("term", (F.col("k") - 1).alias("term_id"))


def precision_recall(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """``(threshold, precision, recall, f1)``: one row per pair in order of descending score, ties by ids.

    ``pairs`` is ``(a, b, s)``; the recall is of all gold pairs, 0 if there
    are none.
    """
    g = gold.select("rec_id", "label")
    of = pairs.select("a", "b", "s").join(g.select(F.col("rec_id").alias("a"), F.col("label").alias("la")), "a").join(g.select(F.col("rec_id").alias("b"), F.col("label").alias("lb")), "b")
    marked = of.select("a", "b", "s", (F.col("la") == F.col("lb")).cast("bigint").alias("hit"), F.lit(1).cast("bigint").alias("one"))
    order = [F.desc("s"), F.col("a"), F.col("b")]
    ran = running_totals(marked, order, {"hits": "hit", "seen": "one"})
    all_gold = g.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(_half(F.col("n"))), F.lit(0.0)).alias("all"))
    return ran.join(F.broadcast(all_gold)).select("a", "b", F.col("s").alias("threshold"), (F.col("hits") / F.col("seen")).alias("precision"), _ratio(F.col("hits"), F.col("all")).alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def merge_trace(merges: DataFrame, gold: DataFrame) -> DataFrame:
    """``(a, b, threshold, precision, recall, f1)`` after each merge, in order of descending score.

    ``merges`` comes from a clustering that was given the same labels. Equal
    scores are in the order of their rounds, then of their ids.
    """
    order = [F.desc("score"), F.col("round"), F.col("a"), F.col("b")]
    ran = running_totals(merges, order, {"hit": "hits", "seen": "pairs"})
    all_gold = gold.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(_half(F.col("n"))), F.lit(0.0)).alias("all"))
    return ran.join(F.broadcast(all_gold)).select("a", "b", F.col("score").alias("threshold"), (F.col("hit") / F.col("seen")).alias("precision"), _ratio(F.col("hit"), F.col("all")).alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
