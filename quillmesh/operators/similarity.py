"""Similarity of records: entities, referers over a taxonomy, and the weighted total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.config import Options
from quillmesh.functions.text import sigmoid
from quillmesh.operators import pairs

COMPONENTS = ("tfidf", "category", "referers", "named")


def entity_counts(rows: DataFrame, record: str, phrases: F.Column) -> DataFrame:
    """``(rec_id, term, cnt)``: how often each phrase of an array column occurs in a record; ``FTP`` and empty ones don't count."""
    return (
        rows.select(rows[record].alias("rec_id"), F.explode(phrases).alias("term"))
        .where("rec_id is not null and term <> '' and term <> 'FTP'")
        .groupBy("rec_id", "term")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def expanded(counts: DataFrame) -> DataFrame:
    """One row per occurrence again: the inverse of counting."""
    return counts.select("rec_id", F.explode(F.array_repeat("term", F.col("cnt").cast("int"))).alias("term"))


def entity_similarity(counts: DataFrame) -> DataFrame:
    """``(a, b, named)`` for a < b: the dot product of phrase counts, letter case kept."""
    return pairs.sums({"named": _weights(counts)}).withColumn("named", F.col("named").cast("bigint"))


def _weights(counts: DataFrame) -> DataFrame:
    return counts.select("rec_id", "term", F.col("cnt").cast("double").alias("w"))


def referer_similarity(pairs: DataFrame, referers: DataFrame, lemmas: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``(a, b, referers)``: sigmoid of the best taxonomy similarity of two records' referers.

    Args:
        pairs: ``(a, b)``.
        referers: ``(rec_id, lemma)``.
        lemmas: ``(lemma, synset)``.
        ancestors: ``(synset, ancestor, ic)``, each synset being its own
            ancestor too, with the ancestor's information content.

    The similarity of two synsets is ``1 / (ic1 + ic2 - 2 ic)`` of their most
    informative common ancestor; synsets of equal content to it count as far
    apart as 1e-9. Pairs without any have 0.5.
    """
    own = ancestors.where("synset = ancestor").select("synset", F.col("ic").alias("own"))
    of = referers.join(lemmas, "lemma").select("rec_id", "synset").distinct().join(own, "synset").join(ancestors, "synset")
    x = of.select(F.col("rec_id").alias("a"), F.col("synset").alias("s"), F.col("own").alias("u"), "ancestor", "ic")
    y = of.select(F.col("rec_id").alias("b"), F.col("synset").alias("t"), F.col("own").alias("v"), "ancestor")
    best = (
        pairs.select("a", "b").join(x, "a").join(y, ["b", "ancestor"])
        .groupBy("a", "b", "s", "t", "u", "v").agg(F.max("ic").alias("shared"))
        .groupBy("a", "b").agg(F.max(F.lit(1.0) / F.greatest(F.col("u") + F.col("v") - 2 * F.col("shared"), F.lit(1e-9))).alias("best"))
    )
    return pairs.select("a", "b").join(best, ["a", "b"], "left").select("a", "b", sigmoid(F.coalesce("best", F.lit(0.0))).alias("referers"))


def total(tfidf: DataFrame, named: DataFrame, options: Options | None = None, referers: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """``(a, b, tfidf, category, referers, named, total)`` of the pairs that share a term or an entity.

    A pair that shares nothing has the constants only and no row. Without
    ``referers`` their part is 0.5; the category part is its weight for every
    pair, or, corrected and given ``(rec_id, category)``, for equal categories.
    """
    o = options or Options()
    p = tfidf.join(named, ["a", "b"], "full")
    same = F.lit(1.0)
    if referers is not None:
        p = p.join(referers, ["a", "b"], "left")
    if o.semantics == "corrected" and categories is not None:
        c = categories.select("rec_id", "category")
        p = p.join(c.select(F.col("rec_id").alias("a"), F.col("category").alias("ca")), "a", "left").join(c.select(F.col("rec_id").alias("b"), F.col("category").alias("cb")), "b", "left")
        same = F.coalesce((F.col("ca") == F.col("cb")).cast("double"), F.lit(0.0))
    return _weighed(p, o, same, F.coalesce("referers", F.lit(0.5)) if referers is not None else F.lit(0.5))


def total_over_terms(terms: DataFrame, counts: DataFrame, options: Options | None = None) -> DataFrame:
    """As :func:`total` without referers and categories, both parts from one meeting of each two records.

    ``terms`` is ``(rec_id, term, w)`` and ``counts`` as for
    :func:`entity_similarity`.
    """
    return _weighed(pairs.sums({"tfidf": terms, "named": _weights(counts)}), options or Options(), F.lit(1.0), F.lit(0.5))


def _weighed(p: DataFrame, o: Options, same: F.Column, referers: F.Column) -> DataFrame:
    part = {
        "tfidf": F.coalesce("tfidf", F.lit(0.0)) * o.tfidf_weight,
        "category": same * o.category_weight,
        "referers": referers * o.referers_weight,
        "named": F.coalesce("named", F.lit(0)).cast("double") * o.named_entity_weight,
    }
    return p.select("a", "b", *(v.alias(k) for k, v in part.items())).withColumn("total", sum((F.col(k) for k in COMPONENTS[1:]), F.col("tfidf")))


def all_pairs(rows: DataFrame, record: str) -> DataFrame:
    """``(a, b)``: every unordered pair of a small table's ids, as the definition of it says."""
    a, b = (rows.select(F.col(record).alias(k)).distinct() for k in "ab")
    return a.join(b, F.col("a") < F.col("b"))
