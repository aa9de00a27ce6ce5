"""Problem 7: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import WORD
from quillmesh.llm.components import contract
from quillmesh.llm.setjoin import SimilarSets
from quillmesh.session import Scratch


def word_hashes(text):
    """Hashes of the words of a text, in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def word_sets(rows: DataFrame, record: str, text, least: int) -> DataFrame:
    """``(id, tokens)``: hashes of the distinct words of each text with at least ``least`` of them.

    Null texts and null ids are left out; repeated rows count once.
    """
    return (
        rows.select(rows[record].cast("bigint").alias("id"), text.alias("t"))
        .where(F.col("id").isNotNull() & F.col("t").isNotNull())
        .select("id", F.array_distinct(word_hashes(F.col("t"))).alias("tokens"))
        .where(F.size("tokens") >= least)
    )


def near_copies(rows: DataFrame, record: str, text, num: int = 7, den: int = 10, least: int = 10) -> SimilarSets:
    """Pairs of texts whose sets of words overlap by at least ``num / den``."""
    return SimilarSets(word_sets(rows, record, text, least), num, den, Scratch(rows.sparkSession))


def near_copy_groups(rows: DataFrame, record: str, text, num: int = 7, den: int = 10, least: int = 10) -> DataFrame:
    """``(group_id, id)``: records that are near copies directly or over others.

    Every record of a group of at least two has one row; ``group_id`` is the
    smallest id of the group. Texts with fewer than ``least`` distinct words
    belong to no group.
    """
    found = near_copies(rows, record, text, num, den, least)
    return contract(found.links(), "a", "b")
