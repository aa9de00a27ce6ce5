"""Problem 9: mixing sources to target weights, exact to the token."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import stripped
from quillmesh.session import Scratch

#: Ranks of a public byte-level vocabulary, and the pattern that splits texts before it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split that belongs to that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(ranks: str, pattern: str):
    """The tokenizer, read once per worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def counted(docs: DataFrame, text: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without its text but with ``tokens``, the size of the whole text; a null text has 0."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema.fields)
    return docs.select(*keep, text).mapInArrow(run, f"{fields}, tokens bigint")


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by ``_``."""
    return F.regexp_replace(stripped(F.lower(c)), r"[\s\-_]+", "_")


class Mix:
    """A choice of documents in which each source has its target share of the tokens.

    Args:
        docs: the corpus; ``doc``, ``text`` and ``source`` name its columns.
        targets: ``(source, target_share, max_repeats)``; spellings of a source
            are joined, its shares added up and its largest cap taken.
        total: tokens of the whole mix; if none is given, as many as the
            listed sources hold.
        seed: of the random order.

    A source's budget is its share of ``total``. It is filled by whole passes
    over the source and then by the head of its hash-random order, found from
    prefix sums over ranges of the hash and within each range; the document
    across the end is cut, so that the budget is met exactly. A source never
    gives more than ``max_repeats`` passes (null: 1); what it then lacks is
    reported and given to no other. Documents with a null id, source or text,
    or without tokens, and sources without a target, aren't used; a source
    that doesn't occur is reported with 0.

    ``chosen`` is ``(doc_id, source, tokens, repeats, last_tokens)``: the
    document's size, how often it is used, and how many tokens of its last use
    count. ``shares`` is ``(source, target_share, max_repeats, available,
    budget, taken, passes, share)``.
    """

    def __init__(self, docs: DataFrame, doc: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 7, ranks: str = RANKS, range_bits: int = 12):
        scratch = Scratch(docs.sparkSession)
        goal = (
            targets.select(source_name(targets["source"]).alias("source"), F.col("target_share").cast("double").alias("s"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("r"))
            .where("source is not null")
            .groupBy("source")
            .agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("target_share"), F.max("r").alias("max_repeats"))
        )
        rows = docs.select(docs[doc].cast("bigint").alias("doc_id"), source_name(docs[source]).alias("source"), docs[text].alias("text")).where("doc_id is not null and text is not null")
        listed = rows.join(goal.select("source"), "source", "left_semi")
        key = F.xxhash64(F.lit(seed), "doc_id")
        sized = scratch.save(
            counted(listed.select("doc_id", "source", "text"), "text", ranks)
            .where("tokens > 0")
            .withColumn("key", key)
            .withColumn("range", F.shiftright(F.col("key"), 64 - range_bits))
        )
        ranges = scratch.save(sized.groupBy("source", "range").agg(F.sum("tokens").alias("in_range")))
        held = ranges.groupBy("source").agg(F.sum("in_range").alias("available"))
        whole = F.lit(total) if total is not None else F.sum("available").over(Window.partitionBy())  # one row per listed source
        budget = F.floor(F.col("target_share") * F.col("whole")).cast("bigint")
        plan = (
            goal.join(held, "source", "left")
            .withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
            .withColumn("whole", F.coalesce(whole, F.lit(0)))
            .withColumn("budget", budget)
            .withColumn("taken", F.least(F.col("budget"), F.col("available") * F.col("max_repeats")))
            .withColumn("full", F.when(F.col("available") > 0, F.expr("taken div available")).otherwise(0).cast("bigint"))
            .withColumn("rest", F.col("taken") - F.col("full") * F.col("available"))
        )
        plan = scratch.save(plan)
        mixed = F.sum("taken").over(Window.partitionBy())
        self.shares = plan.select(
            "source",
            "target_share",
            "max_repeats",
            "available",
            "budget",
            "taken",
            F.round(F.when(F.col("available") > 0, F.col("taken") / F.col("available")).otherwise(0.0), 6).alias("passes"),
            F.round(F.when(mixed > 0, F.col("taken") / mixed).otherwise(0.0), 6).alias("share"),
        )
        by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        start = ranges.select("source", "range", F.coalesce(F.sum("in_range").over(by_range), F.lit(0)).alias("before")).join(plan.select("source", "full", "rest"), "source")
        inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = (
            sized.withColumn("upto", F.sum("tokens").over(inside))
            .join(start, ["source", "range"])
            .withColumn("left", F.col("rest") - (F.col("before") + F.col("upto") - F.col("tokens")))
        )
        more = F.col("left") > 0
        self.chosen = at.where(more | (F.col("full") > 0)).select(
            "doc_id",
            "source",
            "tokens",
            (F.col("full") + more.cast("int")).cast("int").alias("repeats"),
            F.when(more, F.least("tokens", "left")).otherwise(F.col("tokens")).alias("last_tokens"),
        )
