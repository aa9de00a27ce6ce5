"""Problem 3: grouping records into similarity clusters by Markov clustering."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import clean_feature, reduced_category
from quillmesh.llm.components import contract
from quillmesh.llm.setjoin import SimilarSets, whole_groups
from quillmesh.session import Scratch, tasks

#: Censored values that are broadcast.
MOST_CENSORED = 100_000
#: Expansions after which a flow that still moves is reported instead of awaited.
MOST_ROUNDS = 100
#: Vertices of a block that is squared inside one task; larger ones are squared by joins.
SMALL = 512
#: A column has settled if its flow is even to within this; flows within a tenth of the strongest are a tie.
SETTLED, TIE = 1e-3, 0.9
#: Cells of the blocks that are squared in one go.
CELLS = 1 << 21


def feature_sets(features: DataFrame, questions: DataFrame, vocab: DataFrame, least: int = 10) -> DataFrame:
    """``(id, tokens)``: each question's clean features, without censored ones, as hashes that hold its reduced category too.

    Questions with fewer than ``least`` such features, and those that
    ``questions`` lacks, are left out. Two questions of different reduced
    categories share no token.
    """
    censored = vocab.where(vocab["censored"] == 1).select(clean_feature(vocab["feature"]).alias("feature")).where("feature is not null").distinct()
    if censored.limit(MOST_CENSORED + 1).count() <= MOST_CENSORED:
        censored = F.broadcast(censored)  # else the join shuffles
    sets = (
        features.select(features["question_id"].alias("id"), clean_feature(features["feature"]).alias("feature"))
        .where("id is not null and feature is not null")
        .join(censored, "feature", "left_anti")
        .groupBy("id")
        .agg(F.collect_set(F.xxhash64("feature")).alias("own"))
        .where(F.size("own") >= least)
    )
    kinds = questions.select(questions["question_id"].alias("id"), reduced_category(questions["category"]).alias("kind")).where("id is not null").distinct()
    return sets.join(kinds, "id").select("id", F.transform("own", lambda t: F.xxhash64(F.col("kind"), t)).alias("tokens"))


def settle(m: np.ndarray, inflation: float, prune: float, rounds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Markov clustering of many similarity matrices ``(k, n, n)`` of the same size.

    A vertex without neighbours keeps its own flow. Returns the last flows,
    where column j says where the flow that starts in j ends, the number of
    columns of each matrix that still moved, and the rounds.
    """
    loops = m.max(axis=1)
    at = np.arange(m.shape[1])
    m[:, at, at] = np.where(loops > 0, loops, 1.0)
    m /= m.sum(axis=1, keepdims=True)
    moving, left = np.zeros(len(m), np.int64), np.arange(len(m))
    done = 0
    while len(left) and done < rounds:
        x = m[left]
        x = np.matmul(x, x) ** inflation
        x[x < prune * x.max(axis=1, keepdims=True)] = 0.0
        x /= x.sum(axis=1, keepdims=True)
        m[left] = x
        done += 1
        moving[left] = (1 - (x * x).sum(axis=1) / x.max(axis=1) > SETTLED).sum(axis=1)
        left = left[moving[left] > 0]
    return m, moving, done


def _blocks(inflation: float, prune: float, rounds: int):
    """Edges (block, a, b, sim) sorted by block, a = b for a vertex, to (j, block, i, mass, moving, rounds)."""

    def flush(block: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        g = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(block)]))
        # vertices in order of block and id, and the place of each edge's ends inside its block
        ends = np.stack([np.r_[g, g], np.r_[a, b]], axis=1)
        nodes, back = np.unique(ends, axis=0, return_inverse=True)
        back = back.ravel()
        size = np.bincount(nodes[:, 0], minlength=len(first))
        start = np.cumsum(size) - size
        i, j = back[: len(a)] - start[g], back[len(a) :] - start[g]
        width = np.where(size <= 8, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))  # blocks of a width are squared together
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            for part in np.array_split(own, max(1, -(-len(own) * int(w) ** 2 // CELLS))):
                place = np.full(len(first), -1)
                place[part] = np.arange(len(part))
                e = np.flatnonzero((place[g] >= 0) & (i != j))
                m = np.zeros((len(part), w, w))
                m[place[g[e]], i[e], j[e]] = m[place[g[e]], j[e], i[e]] = sim[e]
                m, moving, done = settle(m, inflation, prune, rounds)
                top = m.max(axis=1, keepdims=True)
                to = (m >= TIE * top).argmax(axis=1)  # the smallest id of a tie
                flat = (to + w * np.arange(len(part))[:, None]).ravel()
                label = np.arange(len(flat))
                while True:  # vertices whose strongest flows lead to one end have one label
                    new = np.minimum(label, label[flat])
                    np.minimum.at(new, flat, label)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                label = label.reshape(len(part), w) % w
                k, inside = np.nonzero(np.arange(w) < size[part][:, None])
                at = start[part[k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[at + inside, 1]), pa.array(block[first[part[k]]]), pa.array(nodes[at + label[k, inside], 1]), pa.array(m.sum(axis=2)[k, inside]), pa.array(np.where(inside == 0, moving[k], 0)), pa.array(np.full(len(k), done, np.int32))],
                    names=["j", "block", "i", "mass", "moving", "rounds"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, 100_000):
            yield from flush(*cols)

    return run


class MarkovClusters:
    """Markov clustering of a similarity graph.

    Args:
        pairs: ``(a, b, sim)``, one row per undirected edge, ``sim`` above 0.
        copies: ``(a, b)``: b stands for the same vertex as a; they only bind
            blocks together. None by default.
        inflation: power that strengthens strong flows; higher splits more.
        prune: flows below this share of their column's strongest are dropped,
            so that a column never loses its strongest entries, however many
            they are.
        rounds: most expansions; they end earlier once every column's flow has
            settled on one attractor or evenly on several.
        small: vertices of a block that is squared inside one task.

    Flow never leaves a connected part of the graph, so the matrix consists of
    blocks, one for each part, found by contraction. Blocks of up to ``small``
    vertices are squared inside one task, many at a time; larger ones by
    distributed joins, with the same result.

    ``vertices`` is ``(j, block, i, mass)``: each vertex with its block (the
    smallest id in it, copies included), its cluster (the smallest id of those
    whose strongest flows lead to the same end) and the flow that it draws.
    ``unsettled`` counts the columns whose flow still moved after the last
    round. No pairs and no copies give an empty table.
    """

    def __init__(self, pairs: DataFrame, scratch: Scratch, copies: DataFrame | None = None, inflation: float = 2.0, prune: float = 1e-3, rounds: int = MOST_ROUNDS, small: int = SMALL):
        edges = pairs.select("a", "b", F.col("sim").cast("double").alias("sim"))
        links = edges.select("a", "b")
        if copies is not None:
            links = links.unionByName(copies.select("a", "b"))
            edges = edges.unionByName(copies.select("a", F.col("a").alias("b"), F.lit(0.0).alias("sim")).distinct())
        block = contract(links, "a", "b", scratch).select(F.col("group_id").alias("block"), F.col("id").alias("a"))
        edges = scratch.save(edges.join(block, "a").select("block", "a", "b", "sim"))
        # a block has at most one vertex more than edges, so few blocks need their vertices counted
        many = edges.groupBy("block").count().where(F.col("count") >= small).select("block")
        ends = edges.join(many, "block", "left_semi").select("block", F.explode(F.array("a", "b")).alias("v"))
        large = scratch.save(ends.groupBy("block").agg(F.count_distinct("v").alias("n")).where(F.col("n") > small).select("block"))
        lesser = edges.join(large, "block", "left_anti").repartition(tasks(edges.sparkSession), "block").sortWithinPartitions("block")
        found = scratch.save(lesser.mapInArrow(_blocks(inflation, prune, rounds), "j bigint, block bigint, i bigint, mass double, moving bigint, rounds int"))
        figures = found.agg(F.coalesce(F.sum("moving"), F.lit(0)), F.coalesce(F.max("rounds"), F.lit(0))).first()
        self.unsettled, self.rounds = figures
        self.vertices = found.select("j", "block", "i", "mass")
        if not large.isEmpty():
            more = self._joined(edges.join(large, "block", "left_semi").where("a <> b"), scratch, inflation, prune, rounds)
            self.vertices = scratch.save(self.vertices.unionByName(more.join(block.withColumnRenamed("a", "j"), "j").select("j", "block", "i", "mass")))
            scratch.drop(found)
        scratch.drop(edges)

    def _joined(self, edges: DataFrame, scratch: Scratch, inflation: float, prune: float, rounds: int) -> DataFrame:
        """``(j, i, mass)`` of the vertices of large blocks."""
        arcs = edges.select(
            F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("x"), F.col("sim").alias("w")
        ).select("x.i", "x.j", "w")
        loops = arcs.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w")
        column = Window.partitionBy("j")
        flow = scratch.save(arcs.unionByName(loops).select("i", "j", (F.col("w") / F.sum("w").over(column)).alias("w")))
        done = 0
        while done < rounds:
            left, right = flow.select(F.col("i"), F.col("j").alias("k"), F.col("w").alias("u")), flow.select(F.col("i").alias("k"), F.col("j"), F.col("w").alias("v"))
            squared = left.join(right, "k").groupBy("j", "i").agg(F.sum(F.col("u") * F.col("v")).alias("w"))
            powered = squared.select("i", "j", F.pow("w", F.lit(inflation)).alias("w"))
            kept = powered.withColumn("top", F.max("w").over(column)).where(F.col("w") >= prune * F.col("top"))
            new = scratch.save(kept.select("i", "j", (F.col("w") / F.sum("w").over(column)).alias("w")))
            scratch.drop(flow)
            flow = new
            done += 1
            moving = flow.groupBy("j").agg((1 - F.sum(F.col("w") * F.col("w")) / F.max("w")).alias("chaos")).where(F.col("chaos") > SETTLED)
            if moving.isEmpty():
                break
        else:
            self.unsettled += moving.count()
        self.rounds = max(self.rounds, done)
        near = flow.withColumn("top", F.max("w").over(column)).where(F.col("w") >= TIE * F.col("top"))
        first = scratch.save(near.groupBy("j").agg(F.min("i").alias("i")))
        ends = contract(first, "j", "i", scratch).select(F.col("id").alias("j"), "group_id")
        mass = flow.groupBy("i").agg(F.sum("w").alias("mass")).select(F.col("i").alias("j"), "mass")
        out = first.join(ends, "j", "left").join(mass, "j", "left").select("j", F.coalesce("group_id", "i").alias("i"), F.coalesce("mass", F.lit(0.0)).alias("mass"))
        out = scratch.save(out)
        scratch.drop(flow)
        scratch.drop(first)
        return out

    def warn(self) -> None:
        if self.unsettled:
            warnings.warn(f"{self.unsettled} flows haven't settled after {self.rounds} rounds; their clusters may be preliminary", stacklevel=3)


def clusters(features: DataFrame, questions: DataFrame, vocab: DataFrame, num: int = 3, den: int = 10, least: int = 10, rounds: int = MOST_ROUNDS, small: int = SMALL) -> tuple[SimilarSets, MarkovClusters]:
    """Similarity graph of questions and its Markov clustering."""
    scratch = Scratch(features.sparkSession)
    graph = SimilarSets(feature_sets(features, questions, vocab, least), num, den, scratch, planes=256)
    sim = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    copies = graph.members.where("id <> cid").select(F.col("cid").alias("a"), F.col("id").alias("b"))
    return graph, MarkovClusters(graph.pairs.groupBy("a", "b").agg(F.max(sim).alias("sim")), scratch, copies, rounds=rounds, small=small)


def joined_clusters(graph: SimilarSets, flow: MarkovClusters, size: int = 3) -> DataFrame:
    """``(cluster_id, id)``: Markov clusters, joined where an edge leads from one to another.

    Flow reaches no other block, and inside a block edges lead from every
    cluster to the others, so the joined clusters are those that share a
    block. Each record comes with the Markov cluster of its set; clusters
    under ``size`` records are left out.
    """
    of = flow.vertices.select(F.col("j").alias("cid"), F.col("block").alias("cluster_id"))
    found = graph.members.join(of, "cid").select("cluster_id", "id").distinct()
    big = found.groupBy("cluster_id").count().where(F.col("count") >= size).select("cluster_id")
    return found.join(big, "cluster_id").select("cluster_id", "id")


def described(graph: SimilarSets, flow: MarkovClusters, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, typical)`` of every Markov cluster of at least two records, copies of one set that is like no other included.

    ``cluster_id`` is the smallest id of the cluster, ``size`` counts copies of
    a set too, and ``typical`` lists the members that draw the strongest flow
    of their cluster, up to ``typical`` of them; flows equal to nine digits are
    a tie, which goes by id. Warns of flows that haven't settled.
    """
    flow.warn()
    of = flow.vertices.select("j", F.col("i").alias("attractor"), F.round("mass", 9).alias("mass"))
    w = Window.partitionBy("attractor").orderBy(F.desc("mass"), "j")
    top = of.withColumn("k", F.row_number().over(w)).where(F.col("k") <= typical).groupBy("attractor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda s: s["j"].cast("string")), ",").alias("typical"))
    sizes = of.join(graph.members, F.col("j") == F.col("cid")).groupBy("attractor").agg(F.min("id").alias("cluster_id"), F.count_distinct("id").alias("size")).where("size >= 2")
    return sizes.join(top, "attractor").select("cluster_id", "size", "typical")
