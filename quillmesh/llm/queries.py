"""Queries of the training-data problems and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import ftp_rewrite
from quillmesh.llm import canonical, components, leaks, markov, mixing, neardup, overlap, quality, terms
from quillmesh.llm.sql import oracle_sql  # noqa: F401
from quillmesh.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "answers"), "text", table(spark, d, "cannonical_answer"), "answer_id", "answer_text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers")
    m = _mapped(spark, d)
    return a.join(m, a["text"] == m["value"]).where("response_id is not null").select(a["response_id"], m["entry_id"].alias("answer_id")).distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that stand for no entry, with how often they were typed."""
    a = table(spark, d, "answers")
    m = _mapped(spark, d).where("entry_id = -1")
    return a.join(m, a["text"] == m["value"]).groupBy("value").agg(F.count_distinct("response_id").alias("responses"), F.round(F.max("score"), 6).alias("nearest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = components.contract(table(spark, d, "question_matches"), "left_id", "right_id")
    return found.select("group_id", F.col("id").alias("question_id"))


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    found = components.contract(table(spark, d, "question_matches"), "left_id", "right_id")
    return found.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def _clusters(spark: SparkSession, d: str):
    return markov.clusters(table(spark, d, "features"), table(spark, d, "questions"), table(spark, d, "vocab"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markov.joined_clusters(*_clusters(spark, d)).select("cluster_id", F.col("id").alias("question_id"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return markov.described(*_clusters(spark, d))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "features"), "question_id", "token_offset", "feature").withColumnRenamed("term", "feature").withColumnRenamed("n_records", "n_questions")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark is not null").select("feature", "mark")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctiveness(table(spark, d, "features"), "question_id", "token_offset", "feature")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select(F.col("rec").alias("question_id"), F.col("term").alias("feature"), "n", F.round("z", 6).alias("z"), F.round("tfidf", 6).alias("tfidf"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.standing_out(_scored(spark, d)).select(F.col("rec").alias("question_id"), F.col("term").alias("feature"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    return neardup.near_copy_groups(q, "question_id", ftp_rewrite(q["body"])).select("group_id", F.col("id").alias("question_id"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    s = table(spark, d, "question_split").groupBy(F.col("question_id").alias("id"))
    return s.agg(on("train").alias("train"), on("dev").alias("dev"), on("test").alias("test"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    flags = _splits(spark, d).select("id", "train", (F.col("dev") | F.col("test")).alias("held"))
    return overlap.cross_split(q, "question_id", ftp_rewrite(q["body"]), flags)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "held_id").alias("question_id_a"), F.greatest("train_id", "held_id").alias("question_id_b")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and held-out questions by split and tournament of the held-out question."""
    return p5_report(spark, d).drop("mean_covered")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs, held-out questions and their mean coverage by split and tournament of the held-out question."""
    splits = _splits(spark, d).select(F.col("id").alias("held_id"), F.explode(F.array_compact(F.array(F.when(F.col("dev"), "dev"), F.when(F.col("test"), "test")))).alias("split"))
    q = table(spark, d, "questions")
    of = q.groupBy(q["question_id"].alias("held_id")).agg(F.min("tournament").alias("tournament"))
    return (
        _overlaps(spark, d)
        .join(splits, "held_id")
        .join(of, "held_id", "left")
        .groupBy("split", "tournament")
        .agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("held_id").alias("held_questions"), F.round(F.avg("covered"), 6).alias("mean_covered"))
    )


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of every document, with the number of passages and of words to remove."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "test_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "source_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"), "word")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).where("p_prose < 0.5").select("doc_id")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def queries() -> dict[str, Query]:
    own = (p1_found, p1_unmatched, p2_found, p2_group_sizes, p3_found, p3_clusters, p4_found, p4_terms, p5_found, p5_counts, p5_report, p6_found, p6_scores, p7_found, p8_found, p8_leaks, p9_mix, p9_shares, p10_found, p10_stats)
    return {f.__name__: f for f in own}
