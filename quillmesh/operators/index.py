"""Inverted index over tokens: term and document frequencies, weights and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import QUIZ_WORDS
from quillmesh.operators import pairs
from quillmesh.operators.components import SLACK
from quillmesh.operators.evaluate import numbered as numbered
from quillmesh.session import Scratch


class Index:
    """Statistics of ``(rec_id, term)`` rows, one row per occurrence.

    Args:
        rows: the occurrences; terms are lower-cased.
        start: occurrences added to every document's length (the start symbol).
        keep: a condition on ``term`` that an occurrence must meet to be
            indexed; all do by default.
        semantics: ``reference`` divides whole numbers in the inverse document
            frequency, so that a term in more than half of the documents has
            weight 0; ``corrected`` divides exactly.
    """

    def __init__(self, rows: DataFrame, start: int = 1, semantics: str = "reference", keep: Column | None = None):
        low = rows.select("rec_id", F.lower("term").alias("term"))
        if keep is not None:
            low = low.where(keep)
        counts = low.groupBy("rec_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
        length = counts.groupBy("rec_id").agg((F.sum("cnt") + start).alias("doclen"))
        self.n = length.agg(F.count(F.lit(1)).alias("n_docs"))
        ratio = F.expr("n_docs div df") if semantics == "reference" else F.col("n_docs") / F.col("df")
        self.df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(self.n)).withColumn("idf", F.ln(ratio.cast("double")))
        self.tf = counts.join(length, "rec_id").withColumn("tf", F.col("cnt") / F.col("doclen"))
        #: a weight adds tf * idf once per occurrence
        self.weights = self.tf.join(self.df.select("term", "idf"), "term").withColumn("w", F.col("cnt") * F.col("tf") * F.col("idf"))

    def scores(self) -> DataFrame:
        """``(x, y, score)``: the sum over shared terms of x's squared frequency times idf; zero scores are absent.

        It isn't symmetric. Terms of weight 0 are dropped before the join.
        Every pair that shares a term has a row; :meth:`near` gives the few
        that matter to a threshold.
        """
        return pairs.directed(self.near().x)

    def near(self) -> Near:
        """The same scores, on demand."""
        live = self.weights.where("idf <> 0")
        part = F.col("tf") * F.col("tf") * F.col("idf")
        return Near(live.select("rec_id", "term", part.alias("w")), live.select("rec_id", "term", F.lit(1.0).alias("w")))

    def dot(self) -> DataFrame:
        """``(a, b, tfidf)`` for a < b: the dot product of weights over shared terms."""
        return pairs.sums({"tfidf": self.terms()})

    def terms(self) -> DataFrame:
        """``(rec_id, term, w)``: the weights above 0."""
        return self.weights.where("w <> 0").select("rec_id", "term", "w")

    def linked(self, least: float) -> DataFrame:
        """``(a, b, s)`` for a < b whose dot product is ``least`` or more; other pairs aren't made."""
        rows = self.terms()
        return at_least(rows, rows, least).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "s")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``(rec_id, term, tf, idf)`` of asked ``(rec_id, term)``; 0 where the record lacks the term or no record has it."""
        own = asked.select("rec_id", F.lower("term").alias("term"))
        found = own.join(self.tf.select("rec_id", "term", "tf"), ["rec_id", "term"], "left").join(self.df.select("term", "idf"), "term", "left")
        return found.select("rec_id", "term", F.coalesce("tf", F.lit(0.0)).alias("tf"), F.coalesce("idf", F.lit(0.0)).alias("idf"))

    def report(self) -> tuple[DataFrame, DataFrame]:
        """Documents per term, and distinct terms per document."""
        return self.df.select("term", "df"), self.tf.groupBy("rec_id").agg(F.count(F.lit(1)).alias("terms"))


def dot(rows: DataFrame, weight: str, within: DataFrame | None = None) -> DataFrame:
    """``(a, b, s)`` for a < b: the sum of products over shared terms of ``(rec_id, term, weight)``.

    With ``within``, ``(rec_id, component)``, only pairs of one component are
    made.
    """
    on = ["term"]
    if within is not None:
        rows, on = rows.join(within.select("rec_id", "component"), "rec_id"), ["component", "term"]
    a = rows.select(F.col("rec_id").alias("a"), *on, F.col(weight).alias("u"))
    b = rows.select(F.col("rec_id").alias("b"), *on, F.col(weight).alias("v"))
    return a.join(b, on).where("a < b").groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("s"))


def heads(own: DataFrame, other: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """``(rec_id, term)``: the terms of each record without which the rest can't bring a sum of ``least``.

    Terms go from the most frequent to the rarest; what a record's first terms
    can bring at most, against the largest weights of the other side, falls
    short of ``least``, so these are left out.
    """
    top = other.groupBy("term").agg(F.max("w").alias("most"))
    upto = Window.partitionBy("rec_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.join(top, "term").join(df, "term").withColumn("upto", F.sum(F.col("w") * F.col("most")).over(upto)).where(F.col("upto") >= least - SLACK).select("rec_id", "term")


def at_least(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """``(x, y, s)``: pairs whose sum of products over shared terms is ``least`` or more, of two tables ``(rec_id, term, w)``.

    Weights and ``least`` are above 0. The rarest term that such a pair shares
    is among the heads of both records, so only heads are joined, and the sums
    are made for what that gives. A frequent term is a head of few records.
    """
    if least <= 0:
        raise ValueError("the least sum must be above 0; every pair would do")
    df = x.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    p, q = heads(x, y, df, least), heads(y, x, df, least)
    pairs = p.withColumnRenamed("rec_id", "x").join(q.withColumnRenamed("rec_id", "y"), "term").where("x <> y").select("x", "y").distinct()
    u, v = (t.select(F.col("rec_id").alias(k), "term", F.col("w").alias(w)) for t, k, w in ((x, "x", "u"), (y, "y", "v")))
    return pairs.join(u, "x").join(v, ["y", "term"]).groupBy("x", "y").agg(F.sum(F.col("u") * F.col("v")).alias("s")).where(F.col("s") >= least)


class Near:
    """Scores of x to y as sums of ``w`` products over ``(rec_id, term, w)`` of either side, made only as far as asked for."""

    def __init__(self, x: DataFrame, y: DataFrame):
        self.x, self.y = x, y

    def above(self, least: float) -> DataFrame:
        """``(x, y, score)`` above a threshold, which is above 0."""
        return at_least(self.x, self.y, least).where(F.col("s") > least).withColumnRenamed("s", "score")

    def saved(self, scratch: Scratch) -> Near:
        """The same over written tables, for scores that are asked for again and again."""
        return Near(scratch.save(self.x), scratch.save(self.y))

    def to(self, ids: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
        """``(x, y, score)`` of all records, or those of ``of``, to those of ``ids``, both ``(rec_id)``; zero scores are absent."""
        x, y = (t if k is None else t.join(k.select("rec_id"), "rec_id", "left_semi") for t, k in ((self.x, of), (self.y, ids)))
        u, v = x.select(F.col("rec_id").alias("x"), "term", F.col("w").alias("u")), y.select(F.col("rec_id").alias("y"), "term", F.col("w").alias("v"))
        return u.join(v, "term").where("x <> y").groupBy("x", "y").agg(F.sum(F.col("u") * F.col("v")).alias("score")).where("score <> 0")


def stop_words() -> list[str]:
    """English stop words, as Spark lists them, and those of quiz clues; needs a session."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *QUIZ_WORDS})


def telling(term: Column | None = None, longer: int = 3) -> Column:
    """A term filter for :class:`Index`: no stop word, and more than ``longer`` characters."""
    c = F.lower(F.col("term") if term is None else term)
    return ~c.isin(*stop_words()) & (F.length(c) > longer)
