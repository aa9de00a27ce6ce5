"""Whole entity-resolution runs, and sweeps over their settings."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import CHOICES, Options
from quillmesh.functions import text as X
from quillmesh.operators import blocking, cluster, evaluate, index, similarity
from quillmesh.session import Scratch
from quillmesh.sources import sinks
from quillmesh.sources import tables as S

log = logging.getLogger("quillmesh.runs")
#: Record limits of the standard sweep.
LIMITS = (10, 40, 100, 250, 500)
#: Records up to which iterative blocking with an order-dependent linkage runs, one block after another, on the driver.
SEQUENTIAL = 5000
#: The least excess over the constant parts at which a trace of all merges ends.
LEAST = 1e-9


def grid(spark: SparkSession) -> DataFrame:
    """``(record_limit, tight)``: all settings of the standard sweep, 15 rows."""
    a = spark.createDataFrame([(x,) for x in LIMITS], "record_limit int")
    b = spark.createDataFrame([(x,) for x in CHOICES["tight_threshold"]], "tight string")
    return a.crossJoin(b)


class Run:
    """Questions to clusters to figures, under one set of options.

    Args:
        taxonomy: ``(lemmas, ancestors)`` tables for the referer similarity,
            see ``similarity.referer_similarity``; without them its part is
            the constant of pairs that share none.

    Pairs that share neither a term nor an entity hold only the constant parts
    of the total, so those parts are taken off the threshold instead of being
    added to every pair; a threshold at or below them is an error, since every
    pair would qualify. Referer similarity is computed for the pairs that
    share a term or an entity.
    """

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None, taxonomy: tuple[DataFrame, DataFrame] | None = None):
        o = self.options = options or Options()
        self.scratch = Scratch(spark)
        q, m, c = (S.table(spark, folder, n) for n in ("questions", "question_mapping", "cannonical_answer"))
        answers = S.canonical_answers(m, c)
        chosen = q.select("question_id").where("question_id is not null").distinct()
        if o.restrict_to_dupes:
            chosen = S.limited(S.frequent(q, m, c, o.train_count + o.dev_count + o.test_count), o.limit).select("question_id")
        elif o.limit > 0:
            chosen = chosen.orderBy("question_id").limit(o.limit)
        chosen = self.scratch.save(chosen)
        self.records = chosen.select(F.col("question_id").alias("rec_id"))
        gold = S.answer_lookup(chosen, answers).select(F.col("question_id").alias("rec_id"), F.when(F.col("answer_id") >= 0, F.col("answer_id").cast("string")).otherwise(F.concat(F.lit("none "), "question_id")).alias("label"))
        if o.disambiguations:
            broken = S.broken_lines(spark, o.disambiguations)
            if broken:
                log.warning("%d broken lines in %s are left out", broken, o.disambiguations)
            gold = S.overridden(gold, S.disambiguations(spark, o.disambiguations))
        self.gold = self.scratch.save(gold)
        tokens = S.tokens(S.table(spark, folder, "features")).join(self.records, "rec_id", "left_semi")
        model = S.question_model(q).join(chosen, "question_id", "left_semi").withColumnRenamed("question_id", "rec_id")
        self.entities = self.scratch.save(similarity.entity_counts(model.where("text is not null"), "rec_id", X.entities(F.col("text"))))
        self.categories = model.groupBy("rec_id").agg(F.min("category").alias("category"))
        tfidf, named = index.Index(tokens, semantics=o.semantics).dot(), similarity.entity_similarity(self.entities)
        referers = None
        if taxonomy is not None:
            phrases = model.where("text is not null").select("rec_id", F.explode(X.referers(F.col("text"))).alias("lemma"))
            near = tfidf.select("a", "b").unionByName(named.select("a", "b")).distinct()
            referers = similarity.referer_similarity(near, phrases, *taxonomy)
        pairs = similarity.total(tfidf, named, o, referers=referers, categories=self.categories)
        self.constant = 0.5 * o.referers_weight + (o.category_weight if o.semantics == "reference" else 0.0)
        self.pairs = self.scratch.save(pairs.withColumn("s", F.col("total") - self.constant).where("s > 0").select("a", "b", "s", *similarity.COMPONENTS))
        everything = o.output_format == "MERGE-CSV" or o.write_thresholds
        self.threshold = LEAST if everything else o.feature_distance_threshold - self.constant
        if self.threshold <= 0:
            raise ValueError(f"every pair would qualify at this threshold; it must be above {self.constant}")
        log.info("%d records, %d pairs that share something", self.records.count(), self.pairs.count())

    def clusters(self) -> DataFrame:
        """``(rec_id, cluster)`` by the blocking method and linkage of the options."""
        o = self.options
        if o.blocking_method == "CANOPIES":
            n = self.records.count()
            t2 = blocking.tight_threshold(o.tight_threshold, n)
            cheap = index.Index(similarity.expanded(self.entities), start=0, semantics=o.semantics).scores()  # the tight threshold leaves most of them
            canopy = self.scratch.save(blocking.canopies(self.records, cheap, 0.0, t2))
            log.info("%s", blocking.canopy_size(canopy).first())
            return blocking.canopy_clusters(canopy, self.pairs, self.threshold, o.linkage)
        if o.blocking_method == "LEGO":
            block = blocking.blocks(self.entities, self.categories, o.num_criteria, o.blocking_mask, o.category_mask, o.random_seed if o.random_seed is not None else 42, semantics=o.semantics)
            if o.linkage == "max":
                return blocking.iterative_blocking(self.records, block, self.pairs, self.threshold)
            return self._one_by_one(block)
        if o.linkage == "max":
            return cluster.single_link(self.records, self.pairs, self.threshold)
        return self.agglomerated().clusters

    def _one_by_one(self, block: DataFrame) -> DataFrame:
        """Iterative blocking with minimum or mean linkage, whose result depends on the order of the blocks."""
        n = self.records.count()
        if n > SEQUENTIAL:
            raise ValueError(f"iterative blocking with {self.options.algorithm} takes one block after another, for up to {SEQUENTIAL} records, not {n}; set a limit, or MAXCLUSTER, which is distributed")
        ids = [r[0] for r in self.records.collect()]  # at most SEQUENTIAL, and their pairs
        held: dict[tuple, list[int]] = {}
        for r in block.orderBy("criterion", "key", "rec_id").collect():
            held.setdefault((r["criterion"], r["key"]), []).append(r["rec_id"])
        sim = {(r["a"], r["b"]): r["s"] for r in self.pairs.select("a", "b", "s").collect()}
        found = blocking.iterative_blocks(dict(enumerate(held.values())), sim, ids, self.threshold, self.options.linkage)
        return self.records.sparkSession.createDataFrame(list(found.items()), "rec_id bigint, cluster bigint")

    def agglomerated(self) -> cluster.Clustering:
        """Clusters without blocking, with the merges and the parts of their scores."""
        o = self.options
        return cluster.agglomerate(self.records, self.pairs, self.threshold, o.linkage, gold=self.gold, scratch=self.scratch, parts=similarity.COMPONENTS)

    def report(self) -> DataFrame:
        """Seven figures and the relevant settings, one row."""
        row = evaluate.Contingency(self.clusters(), self.gold, self.scratch).report()
        return row.withColumns({k.lower(): F.lit(v) for k, v in self.options.relevant()})

    def informative(self) -> DataFrame:
        """``(feature, value)``: what the parts of the similarity added to the merges."""
        return self.agglomerated().informative(similarity.COMPONENTS)

    def trace(self) -> DataFrame:
        """Figures after every merge without blocking, down to pairs that share nothing."""
        found = evaluate.merge_trace(self.agglomerated().merges, self.gold)
        return found.withColumn("threshold", F.col("threshold") + self.constant)

    def thresholds(self) -> DataFrame:
        """Figures of every possible threshold on the pairs."""
        found = evaluate.precision_recall(self.pairs.select("a", "b", "s"), self.gold)
        return found.withColumn("threshold", F.col("threshold") + self.constant)

    def output(self, path: str | None = None) -> str:
        """What the options ask for, as text; traces and curves, which have a row for each merge or pair, go to CSV files under ``path``."""
        o = self.options
        if o.write_thresholds or o.output_format == "MERGE-CSV":
            if path is None:
                raise ValueError("a trace or curve needs a path to write to")
            lines = sinks.trace_lines(self.thresholds() if o.write_thresholds else self.trace())
            lines.write.mode("overwrite").option("header", True).csv(path)
            return path
        return sinks.report_text(self.report(), o)


def sweep(spark: SparkSession, folder: str, limits=LIMITS, tight=CHOICES["tight_threshold"], **options) -> DataFrame:
    """The report of a canopy run for every setting, one row each; the run of a limit is set up once for all its thresholds."""
    out = None
    for limit in limits:
        run = None
        for kind in tight:
            o = Options(blocking_method="CANOPIES", limit=limit, tight_threshold=kind, **options)
            run = run or Run(spark, folder, o)
            run.options = o
            row = run.report().withColumn("tight", F.lit(kind))
            out = row if out is None else out.unionByName(row)
    return out
