"""Problems 4 and 6: term frequencies and how distinctive a term is per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import clean_feature
from quillmesh.session import Scratch


def record_terms(rows: DataFrame, record: str, position: str, term: str) -> DataFrame:
    """Per-record term counts ``(rec, term, n)`` of a long token table.

    Terms are trimmed and lower-cased; null and empty ones, and rows without a
    record id, are left out; equal (record, position, term) count once, where
    two null positions are equal. Both steps combine by hash before their
    shuffle, and neither gathers a record or a term in one task.
    """
    return (
        rows.select(rows[record].alias("rec"), rows[position].alias("pos"), clean_feature(rows[term]).alias("term"))
        .where(F.col("term").isNotNull() & F.col("rec").isNotNull())
        .distinct()
        .groupBy("rec", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def record_count(rows: DataFrame, record: str, term: str) -> DataFrame:
    """One row ``n_rec``: the number of records with a clean term."""
    return (
        rows.select(rows[record].alias("rec"), clean_feature(rows[term]).alias("term"))
        .where(F.col("term").isNotNull())
        .agg(F.count_distinct("rec").alias("n_rec"))
    )


def term_frequencies(rows: DataFrame, record: str, position: str, term: str, least: int = 3, share: float = 0.2) -> DataFrame:
    """Occurrences and records of every distinct term, with a frequency mark.

    Returns ``(term, n_rows, n_records, mark)``; mark is ``rare`` below
    ``least`` records, ``common`` above ``share`` of all records that have a
    term, else null. An empty table gives no rows.
    """
    n = record_count(rows, record, term)
    return (
        record_terms(rows, record, position, term)
        .groupBy("term")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))
        .join(F.broadcast(n))  # one row
        .select(
            "term",
            "n_rows",
            "n_records",
            F.when(F.col("n_records") < least, "rare").when(F.col("n_records") > F.col("n_rec") * F.lit(share), "common").alias("mark"),
        )
    )


def distinctiveness(rows: DataFrame, record: str, position: str, term: str, prior: float = 500.0) -> DataFrame:
    """How characteristic every term of a record is of that record.

    Returns, for each record and each of its clean terms,
    ``(rec, term, n, n_rec_rows, n_records, z, tfidf)``. ``z`` is the log-odds
    ratio of the record against all other records, with an informative
    Dirichlet prior of ``prior`` rows spread as the whole collection is,
    divided by its standard error. ``tfidf`` is ``n / n_rec_rows * ln(N /
    n_records)``. A term that is all of the collection has a null ``z``.

    A hot term's statistics, or a hot record's total, meet their rows in sort
    merge joins whose large side AQE splits.
    """
    terms = Scratch(rows.sparkSession).save(record_terms(rows, record, position, term))  # read three times
    of_term = terms.groupBy("term").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))
    of_rec = terms.groupBy("rec").agg(F.sum("n").alias("n_rec_rows"))
    whole = of_rec.agg(F.count(F.lit(1)).alias("n_rec"), F.sum("n_rec_rows").alias("n_all"))
    y, ni, yw, na = (F.col(c).cast("double") for c in ("n", "n_rec_rows", "n_rows", "n_all"))
    alpha = F.lit(prior) * yw / na
    own, rest = y + alpha, yw - y + alpha
    own_not, rest_not = ni + F.lit(prior) - own, na - ni + F.lit(prior) - rest
    z = (F.ln(own / own_not) - F.ln(rest / rest_not)) / F.sqrt(F.lit(1.0) / own + F.lit(1.0) / rest)
    return (
        terms.join(of_term, "term")
        .join(of_rec, "rec")  # last, so that what follows by record needs no shuffle
        .join(F.broadcast(whole))  # one row
        .select(
            "rec",
            "term",
            "n",
            "n_rec_rows",
            "n_records",
            F.when((own_not > 0) & (rest_not > 0), z).alias("z"),
            (y / ni * F.ln(F.col("n_rec") / F.col("n_records"))).alias("tfidf"),
        )
    )


def standing_out(scored: DataFrame, ratio: float = 1.45) -> DataFrame:
    """The one term that sets a record apart, from :func:`distinctiveness`.

    Candidates are the terms with a ``z`` above 0, those more frequent in the
    record than in the whole collection, whatever the prior. The exact check
    follows: terms held by one record only are left out; a record appears if
    it has at least two terms, candidate or not, and its candidate's ``tfidf``
    is above 0 and at least ``ratio`` times that of every other term. Ties of
    the two best give no row. Spark limits each group to its two best rows.
    """
    w = Window.partitionBy("rec").orderBy(F.desc("tfidf"), F.col("term"))
    two = (
        scored.where(F.col("n_records") > 1)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= 2)
        .groupBy("rec")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.max(F.when(F.col("rank") == 1, F.col("tfidf"))).alias("best"),
            F.max(F.when(F.col("rank") == 2, F.col("tfidf"))).alias("next"),
            F.max(F.when((F.col("rank") == 1) & (F.col("z") > 0), F.col("term"))).alias("term"),
        )
    )
    best: Column = F.col("best")
    return two.where((F.col("k") == 2) & (best > 0) & (best >= F.lit(ratio) * F.col("next")) & F.col("term").isNotNull()).select("rec", "term")
