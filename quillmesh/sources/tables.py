"""Readers and writers of the project's tables, and the question model built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import category, clean_feature, ftp_rewrite


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """One table of a relational database, with pushdown of filters and columns."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def tokens(features: DataFrame) -> DataFrame:
    """``(rec_id, pos, term)``: clean tokens; repeated rows count once, rows without an id or a value don't."""
    return (
        features.select(features["question_id"].alias("rec_id"), features["token_offset"].alias("pos"), clean_feature(features["feature"]).alias("term"))
        .where("rec_id is not null and term is not null")
        .distinct()
    )


def vocabulary(vocab: DataFrame) -> DataFrame:
    """``(feature, censored, word_id)`` with the empty start symbol after the largest id."""
    own = vocab.select("feature", "censored", "word_id")
    start = own.agg((F.max("word_id") + 1).alias("word_id")).select(F.lit("").alias("feature"), F.lit(0).alias("censored"), "word_id")
    return own.unionByName(start)


def canonical_answers(mapping: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(question_id, answer_id, answer_text)``; of several answers of a question the largest id counts."""
    return (
        mapping.join(canonical, "answer_id")
        .where("question_id is not null")
        .groupBy("question_id")
        .agg(F.max(F.struct("answer_id", "answer_text")).alias("a"))
        .select("question_id", "a.answer_id", "a.answer_text")
    )


def answer_lookup(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question id with its answer, ``-1`` and an empty text where it has none."""
    ids = questions.select("question_id").where("question_id is not null").distinct()
    return ids.join(answers, "question_id", "left").select("question_id", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"), F.coalesce("answer_text", F.lit("")).alias("answer_text"))


def responses(answers: DataFrame) -> DataFrame:
    """Per question: reference rows, human rows, and how many of those are right and wrong.

    A reference row has ``reference`` 1, a human one any user but ``default``;
    a row may be both or neither. Repeated rows count once.
    """
    human = F.coalesce(F.col("username") != "default", F.lit(False))
    return (
        answers.where("question_id is not null")
        .distinct()
        .groupBy("question_id")
        .agg(
            F.count_if(F.col("reference") == 1).alias("reference_rows"),
            F.count_if(human).alias("human_rows"),
            F.count_if(human & (F.col("correct") == 1)).alias("right"),
            F.count_if(human & (F.col("correct") == 0)).alias("wrong"),
        )
    )


def answer_lists(answers: DataFrame) -> DataFrame:
    """``(question_id, reference, human)``: the texts of a question's reference rows and of its human rows, sorted; see :func:`responses`.

    The lists are the feature here; a question's rows gather in one task.
    Repeated rows count once, null texts not at all.
    """
    human = F.coalesce(F.col("username") != "default", F.lit(False))
    return (
        answers.where("question_id is not null")
        .distinct()
        .groupBy("question_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("reference") == 1, F.col("text")))).alias("reference"), F.sort_array(F.collect_list(F.when(human, F.col("text")))).alias("human"))
    )


def mapped_features(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(question_id, pos, word_id)``: a question's tokens as word numbers, the start symbol at 0 before them; unknown tokens are left out.

    A feature that ``vocab`` lists more than once has its smallest number.
    """
    known = vocabulary(vocab).where("feature is not null").groupBy(F.lower("feature").alias("term")).agg(F.min("word_id").alias("word_id"))
    own = tokens(features)
    start = own.select("rec_id").distinct().select("rec_id", F.lit(0).alias("pos"), F.lit("").alias("term"))
    return own.unionByName(start).join(known, "term").select(F.col("rec_id").alias("question_id"), "pos", "word_id")


def frequent(questions: DataFrame, mapping: DataFrame, canonical: DataFrame, least: int = 5) -> DataFrame:
    """Questions whose answer is given at least ``least`` times: ``(question_id, answer_id, answer_text, answer_count)``."""
    return (
        questions.select("question_id")
        .join(mapping, "question_id")
        .join(canonical.where(F.col("answer_count") >= least), "answer_id")
        .select("question_id", "answer_id", "answer_text", "answer_count")
        .distinct()
    )


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The questions of the most frequent answers, ``limit`` of them, or all if it isn't above 0; ties by id."""
    ranked = rows.groupBy("question_id").agg(F.max("answer_count").alias("answer_count"))
    return ranked if limit <= 0 else ranked.orderBy(F.desc("answer_count"), "question_id").limit(limit)


def question_model(questions: DataFrame, reducer: Callable[[Column], Column] | None = category) -> DataFrame:
    """Distinct questions with rewritten body and reduced category; ``reducer`` may be another function of the trimmed category, or none."""
    kind = F.trim("category")
    return questions.where("question_id is not null").select("question_id", ftp_rewrite(F.col("body")).alias("text"), (reducer(kind) if reducer else kind).alias("category"), "author", "round", "tournament").distinct()


def ordered_features(features: DataFrame) -> DataFrame:
    """``(question_id, features)``: each question's clean tokens in order of offset and value."""
    return tokens(features).groupBy(F.col("rec_id").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]).alias("features"))


def marker_position(features: DataFrame, marker: str = "ftp") -> DataFrame:
    """Last offset of a marker token per question, -1 without one."""
    return tokens(features).groupBy(F.col("rec_id").alias("question_id")).agg(F.coalesce(F.max(F.when(F.col("term") == marker, F.col("pos"))), F.lit(-1)).alias("ftp_pos"))


def split(labels: DataFrame, record: str, label: str, dev: int = 0, test: int = 1) -> DataFrame:
    """Test, dev or train for each record: the first ``test`` rows of a label in id order, the next ``dev``, then the rest.

    Only the head of each label is ranked, and Spark cuts it before the
    shuffle, so a label with a third of all rows costs nothing more.
    """
    own = labels.select(labels[record].alias("rec_id"), labels[label].alias("label")).where("rec_id is not null and label is not null").distinct()
    k = F.row_number().over(Window.partitionBy("label").orderBy("rec_id"))
    head = own.withColumn("k", k).where(F.col("k") <= test + dev).withColumn("split", F.when(F.col("k") <= test, "test").otherwise("dev")).drop("k")
    return own.join(head, ["rec_id", "label"], "left").select("rec_id", "label", F.coalesce("split", F.lit("train")).alias("split"))


def disambiguations(spark: SparkSession, path: str) -> DataFrame:
    """``(rec_id, label)`` lines without a header; a broken line is left out and the rest kept, see :func:`broken_lines`."""
    return spark.read.schema("rec_id bigint, label string").option("mode", "DROPMALFORMED").csv(path).where("rec_id is not null and label is not null")


def broken_lines(spark: SparkSession, path: str) -> int:
    """How many lines of a disambiguations file are no number and label."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*-?\d+\s*,[^,]+$") & (F.trim("value") != "")).count()


def overridden(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(rec_id, label)`` as text, with an override where there is one."""
    o = overrides.groupBy("rec_id").agg(F.max("label").alias("own"))
    return labels.join(o, "rec_id", "left").select("rec_id", F.coalesce("own", F.col("label").cast("string")).alias("label"))


def export(questions: DataFrame, mapping: DataFrame, canonical: DataFrame, least: int = 5) -> DataFrame:
    """Questions of frequent answers with a quoted body, as lines for a CSV file, the most frequent answers first, then by answer and question."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("body", F.lit("")), F.lit('"'), F.lit("")), F.lit('"'))
    return frequent(questions, mapping, canonical, least).join(questions.select("question_id", "body").distinct(), "question_id").select("question_id", "answer_text", "answer_count", quoted.alias("body")).distinct().orderBy(F.desc("answer_count"), "answer_text", "question_id", "body")


def write_ids(rows: DataFrame, path: str) -> None:
    """Record numbers with their labels as CSV without header or quotes."""
    rows.write.mode("overwrite").option("quote", "").csv(path)
