"""Problem 7's engine: a lossless similarity self-join of token sets by bit-sliced comparison.

Two sets overlap by at least t only if their symmetric difference has at most
``(1 - t) / (1 + t) * (|A| + |B|)`` members. A parity sketch (each token flips
one of P bits) differs in no more bits than the symmetric difference has
members, so a Hamming radius on sketches discards pairs without losing any.

Candidates share a token of their prefixes (the rarest tokens, of which any
two similar sets have one in common). Inside such a block the sketches are
stored as bit planes, 64 records to a machine word; one record is compared
with 64 others at a time, its distances held in carry-save counters, and a
block is abandoned as soon as all its lanes exceed the radius. What is left is
checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import Scratch, tasks

#: Most tokens whose frequency is handed to every task (16 bytes each), and the sets below which a token's frequency is taken as 0.
MOST_HEAVY, SELDOM = 1 << 20, 64
#: Tokens held by so many sets are never a block of their own, whatever the number of sets.
HOT = 4096
#: Rows of a group that are compared one by one.
FEW = 32
#: Tasks (record against 64 lanes) compared in one go.
SLICE = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketches(flat: np.ndarray, row: np.ndarray, rows: int, planes: int) -> np.ndarray:
    """Parity sketches as ``(rows, planes / 64)`` words of 64 bits."""
    bit = (_mix(flat.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % planes
    odd = (np.bincount(row * planes + bit, minlength=rows * planes) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, planes), axis=1, bitorder="little").view(np.uint64)


def frequencies(part, lists: int, heavy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a list column, end to end, with their number of sets, and the sizes of the lists.

    The numbers come from the frequent tokens handed to the task, or from the
    column after the tokens where there are too many of those; 0 if seldom.
    """
    column = part.column(lists)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy()
    if heavy is None:
        return flat, part.column(lists + 1).flatten().to_numpy(), n
    tokens, df = heavy.value
    if not len(tokens):
        return flat, np.zeros(len(flat), np.int64), n
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    return flat, np.where(tokens[at] == flat, df[at], 0), n


def prefixes(flat: np.ndarray, df: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with their frequencies and rows, rarest first in each row, the place of each in its row, and the length of each row's prefix.

    Two sets that overlap enough share a token of their prefixes, and two
    tokens of prefixes one longer unless one token is enough for them.
    """
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, df, row))
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    return flat[order], df[order], row, pos, n - (n * num + den - 1) // den + 1


def hot_pairs(flat: np.ndarray, row: np.ndarray, warm: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every two marked tokens of a row, and its row."""
    at = np.flatnonzero(warm)
    many = np.bincount(row[at], minlength=rows)
    after = many[row[at]] - 1 - (np.arange(len(at)) - (np.cumsum(many) - many)[row[at]])  # marked tokens that follow in the row
    i = np.repeat(np.arange(len(at)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    return _mix(flat[at[i]].view(np.uint64) + np.uint64(7) * _mix(flat[at[j]].view(np.uint64))).view(np.int64), row[at[i]]


def _postings(heavy, num: int, den: int, planes: int, hot: int, hot_only: bool):
    """Rows (cid, tokens[, df]) to rows (key, hot, cid, n, s0, s1, ...): one for each block a set is in; or to the keys of the hot ones alone.

    A token of ``hot`` sets or more is no block, but every two of them are;
    those are marked, since they may be hot themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                cid = part.column(0).to_numpy()
                flat, df, n = frequencies(part, 1, heavy)
                if not hot_only:
                    sk = sketches(flat, np.repeat(np.arange(len(n)), n), len(n), planes)
                flat, df, row, pos, prefix = prefixes(flat, df, n, num, den)
                inside = pos < prefix[row]
                single = inside & (df < hot)
                tiny = inside & (df >= hot) & (n * num <= den)[row]  # one token may be enough for these
                pair, at = hot_pairs(flat, row, (pos < prefix[row] + 1) & (df >= hot), len(n))
                if hot_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[flat[tiny], pair])], names=["key"])
                    continue
                key, at = np.r_[flat[single], flat[tiny], pair], np.r_[row[single], row[tiny], at]
                marked = np.arange(len(key)) >= single.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(marked), pa.array(cid[at]), pa.array(n[at].astype(np.int32)), *(pa.array(sk[at, k].view(np.int64)) for k in range(planes // 64))],
                    names=["key", "hot", "cid", "n", *(f"s{k}" for k in range(planes // 64))],
                )

    return run


def in_chunks(rows: DataFrame, often: DataFrame, who: str, hot: int, scratch: Scratch) -> DataFrame:
    """Rows whose marked ``key`` is in ``often`` (key, count), cut into chunks of about ``hot`` rows that meet pairwise, each pair in a block of its own.

    The chunk goes by the hash of ``who``. No pair of rows is lost: two chunks
    meet in the cell of their numbers.
    """
    c = F.coalesce("count", F.lit(0))
    many = F.lit(1) + F.floor(c / hot)
    own = F.pmod(F.xxhash64(F.lit(5), F.col(who)), many)
    none = F.lit(-1).cast("bigint")
    cells = F.when(F.col("count").isNull(), F.array(none)).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), many - 1), lambda x: F.least(x, own) * many + F.greatest(x, own)))
    if often.count() <= MOST_HEAVY:
        marked = often.withColumn("hot", F.lit(True))
        met = rows.join(F.broadcast(marked), ["key", "hot"], "left")  # in one pass over the rows
        return met.withColumn("cell", F.explode(cells)).withColumn("key", F.when(F.col("cell") < 0, F.col("key")).otherwise(F.xxhash64("key", "cell"))).select(rows.columns)
    rows = scratch.save(rows)
    met = rows.where("hot").join(often, "key", "left")
    cut = met.withColumn("cell", F.explode(cells)).withColumn("key", F.when(F.col("cell") < 0, F.col("key")).otherwise(F.xxhash64("key", "cell"))).select(rows.columns)
    return rows.where("not hot").unionByName(cut)


def _csa(a, b, c):
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _beyond(counters: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose count, held in bit-sliced counters, exceeds the radius."""
    over, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        r = np.uint64(0) - ((radius >> np.uint64(k)) & np.uint64(1))
        over |= same & counters[k] & ~r
        same &= ~(counters[k] ^ r)
    return over


def _near(i: np.ndarray, j: np.ndarray, n: np.ndarray, sk: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sketches and sizes allow the overlap."""
    keep = np.maximum(n[i], n[j]) * num <= np.minimum(n[i], n[j]) * den
    i, j = i[keep], j[keep]
    keep = np.bitwise_count(sk[i] ^ sk[j]).sum(axis=1) * (den + num) <= (den - num) * (n[i] + n[j])
    return i[keep], j[keep]


def near_pairs(group: np.ndarray, n: np.ndarray, sk: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose sketches lie within their radius.

    ``group`` is ascending and ``n`` ascending within a group. Returns row
    numbers i < j. Groups of more than ``FEW`` rows are compared bit-sliced,
    which would fill no word in smaller ones.
    """
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    few = np.repeat(size <= FEW, size)
    inside = np.arange(len(group)) - np.repeat(first, size)
    after = np.where(few, np.repeat(size, size) - 1 - inside, 0)
    i = np.repeat(np.arange(len(group)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    i, j = _near(i, j, n, sk, num, den)
    rest = np.flatnonzero(~few)
    if len(rest):
        x, y = sliced_pairs(group[rest], n[rest], sk[rest], num, den)
        i, j = np.r_[i, rest[x]], np.r_[j, rest[y]]
    return i, j


def sliced_pairs(group: np.ndarray, n: np.ndarray, sk: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose sketches lie within their radius.

    ``group`` is ascending and ``n`` ascending within a group. Returns row
    numbers i < j.
    """
    rows, planes = len(n), sk.shape[1] * 64
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, rows])
    blocks = (size + 63) // 64
    base = np.cumsum(blocks) - blocks
    g = np.repeat(np.arange(len(first)), size)
    inside = np.arange(rows) - first[g]
    block, lane = base[g] + inside // 64, inside % 64
    total = int(blocks.sum())
    bits = np.zeros((total * 64, planes), np.uint8)
    bits[block * 64 + lane] = np.unpackbits(sk.view(np.uint8), axis=1, bitorder="little")
    vertical = np.packbits(bits.reshape(total, 64, planes), axis=1, bitorder="little")  # total, 8, planes
    vertical = np.ascontiguousarray(vertical.transpose(2, 0, 1)).view(np.uint64).reshape(planes, total)
    del bits
    row_of = np.full(total * 64, -1)
    row_of[block * 64 + lane] = np.arange(rows)
    held = np.zeros(total, np.int64)
    np.add.at(held, block, 1)
    valid = np.where(held == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(held, 63).astype(np.uint64)) - np.uint64(1))
    starts = np.flatnonzero(lane == 0)
    least_n, most_n = np.zeros(total, np.int64), np.zeros(total, np.int64)
    least_n[block[starts]] = n[starts]
    np.maximum.at(most_n, block, n)
    reach = base[g] + blocks[g] - block  # blocks from a row's own to its group's last
    out_i, out_j = [], []
    each = np.cumsum(reach)
    at = 0
    while at < rows:  # rows whose tasks fill a slice
        stop = max(at + 1, int(np.searchsorted(each, (each[at - 1] if at else 0) + SLICE, side="right")))
        r = np.repeat(np.arange(at, stop), reach[at:stop])
        b = block[r] + np.arange(len(r)) - np.repeat(np.cumsum(reach[at:stop]) - reach[at:stop], reach[at:stop])
        at = stop
        alive = valid[b].copy()
        own = b == block[r]
        alive[own] &= (~np.uint64(0) << lane[r[own]].astype(np.uint64)) & ~(np.uint64(1) << lane[r[own]].astype(np.uint64))
        near = (alive != 0) & (least_n[b] * num <= n[r] * den)
        r, b, alive = r[near], b[near], alive[near]
        # no two sketches differ in more bits than there are, and the counters hold no more
        radius = np.minimum((den - num) * (n[r] + most_n[b]) // (den + num), planes).astype(np.uint64)
        zero = np.zeros(len(r), np.uint64)
        count = [zero] * (int(planes).bit_length())
        for p in range(0, planes, 8):
            word, shift = p // 64, p % 64
            d = [vertical[p + k][b] ^ (np.uint64(0) - ((sk[r, word] >> np.uint64(shift + k)) & np.uint64(1))) for k in range(8)]
            twos_a, count[0] = _csa(count[0], d[0], d[1])
            twos_b, count[0] = _csa(count[0], d[2], d[3])
            fours_a, count[1] = _csa(count[1], twos_a, twos_b)
            twos_a, count[0] = _csa(count[0], d[4], d[5])
            twos_b, count[0] = _csa(count[0], d[6], d[7])
            fours_b, count[1] = _csa(count[1], twos_a, twos_b)
            carry, count[2] = _csa(count[2], fours_a, fours_b)
            for k in range(3, len(count)):
                count[k], carry = count[k] ^ carry, count[k] & carry
            if p % 16 == 8:
                alive &= ~_beyond(count, radius)
                keep = alive != 0
                if keep.sum() < 0.8 * len(keep):  # abandon blocks with no lane left
                    r, b, alive, radius = r[keep], b[keep], alive[keep], radius[keep]
                    count = [c[keep] for c in count]
            if not len(r):
                break
        if len(r):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, k = np.nonzero(hit)
            out_i.append(r[t])
            out_j.append(row_of[b[t] * 64 + k])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _near(np.concatenate(out_i), np.concatenate(out_j), n, sk, num, den)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of about ``rows`` rows at a time, with no group of the first column cut; groups come one after another."""
    parts: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([c.to_numpy() for c in batch.columns])
        held += batch.num_rows
        if held >= rows:
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if cols[0][0] != cols[0][-1] else 0
            if cut:  # the last group may go on in the next batch
                yield [x[:cut] for x in cols]
            parts, held = [[x[cut:] for x in cols]], len(cols[0]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def found_pairs(key: np.ndarray, cid: np.ndarray, n: np.ndarray, planes: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one key whose sketches are near and whose classes differ."""
    i, j = near_pairs(key, n.astype(np.int64), np.stack([x.view(np.uint64) for x in planes], axis=1), num, den)
    other = cid[i] != cid[j]
    return i[other], j[other]


def as_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, smaller first."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _compare(num: int, den: int):
    """Postings (key, cid, n, s0, ...) sorted by (key, n) to candidate pairs (a, b), a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, n, *planes in whole_groups(batches, 50_000):
            i, j = found_pairs(key, cid, n, planes, num, den)
            yield as_pairs(cid[i], cid[j])

    return run


def with_frequencies(sets: DataFrame, who: str, tokens: str, hot: int, scratch: Scratch, most: int | None = None) -> tuple[DataFrame, object, bool]:
    """Sets ready for :func:`frequencies`, the frequent tokens as a broadcast, and whether any token is held by ``hot`` sets.

    Up to ``most`` (``MOST_HEAVY``) tokens that ``SELDOM`` sets hold are
    broadcast. Where there are more, nothing is: the frequencies are joined to
    the sets' tokens, in a column after them.
    """
    counts = sets.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    frequent = scratch.save(counts.where(F.col("df") >= min(SELDOM, hot)))
    any_hot = not frequent.where(F.col("df") >= hot).isEmpty()
    if frequent.count() <= (MOST_HEAVY if most is None else most):
        table = frequent.toArrow()
        token, df = table.column(0).to_numpy(), table.column(1).to_numpy()
        order = np.argsort(token)
        return sets, sets.sparkSession.sparkContext.broadcast((token[order], df[order])), any_hot
    key = [F.col(who).alias("k0"), F.xxhash64(tokens).alias("k1")]  # an id may come with several sets
    own = sets.select(*key, F.explode(tokens).alias("token")).join(frequent, "token", "left")
    lists = own.groupBy("k0", "k1").agg(F.collect_list(F.struct("token", F.coalesce("df", F.lit(0)).alias("df"))).alias("x"))
    rest = [c for c in sets.columns if c not in (who, tokens)]
    joined = sets.select(*key, *rest).join(lists, ["k0", "k1"]).select(F.col("k0").alias(who), F.col("x.token").alias(tokens), F.col("x.df").alias("df"), *rest)
    return scratch.save(joined), None, any_hot


class SimilarSets:
    """Classes of equal sets, and the pairs of classes that overlap enough.

    Args:
        sets: ``(id bigint, tokens array<bigint>)``; tokens are hashes, which
            may include a partition's name so that only sets of one partition
            can meet. Null and empty sets are left out, a repeated token
            counts once.
        num, den: the least overlap as a fraction, above 0.
        planes: bits of a sketch, a multiple of 64.
        hot: sets that hold a token from which it is no block of its own.

    ``members`` is ``(id, cid)`` with one row per different id and set, ``cid``
    the smallest id that has the same set (an id given with several sets has
    each of them); ``pairs`` is ``(a, b, shared, na,
    nb)`` with one row per pair of different sets, exact: sizes and shared
    tokens are of the sets themselves. No pair is lost and nothing is capped:
    tokens held by ``hot`` sets or more become blocks only two at a time, and
    those of them that ``hot`` sets still hold are cut into chunks that meet
    pairwise, so that no task compares more than a few ``hot`` sets at once.
    """

    def __init__(self, sets: DataFrame, num: int, den: int, scratch: Scratch, planes: int = 128, hot: int = HOT):
        spark = sets.sparkSession
        digest = [F.xxhash64(F.lit(k), F.col("tokens")).alias(f"d{k}") for k in (1, 2)]
        own = scratch.save(
            sets.select(F.col("id"), F.sort_array(F.array_distinct("tokens")).alias("tokens")).where(F.size("tokens") > 0).select("id", "tokens", *digest)
        )
        first = own.groupBy("d1", "d2").agg(F.min("id").alias("cid"))
        self.members = scratch.save(own.select("id", "d1", "d2").join(first, ["d1", "d2"]).select("id", "cid").distinct())
        # an id with several sets may stand for several classes; each keeps its own row
        self.classes = scratch.save(own.groupBy("d1", "d2").agg(F.min("id").alias("cid"), F.first("tokens").alias("tokens")).select("cid", "tokens"))
        scratch.drop(own)
        scratch.release()
        source, heavy, any_hot = with_frequencies(self.classes, "cid", "tokens", hot, scratch)
        total = self.classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
        words = planes // 64
        schema = "key bigint, hot boolean, cid bigint, n int, " + ", ".join(f"s{k} bigint" for k in range(words))
        postings = source.mapInArrow(_postings(heavy, num, den, planes, hot, False), schema)
        if any_hot:
            often = scratch.save(source.mapInArrow(_postings(heavy, num, den, planes, hot, True), "key bigint").groupBy("key").count().where(F.col("count") >= hot))
            postings = in_chunks(postings, often, "cid", hot, scratch) if not often.isEmpty() else postings
        found = postings.drop("hot").repartition(tasks(spark, total, 1_000_000), "key").sortWithinPartitions("key", "n").mapInArrow(_compare(num, den), "a bigint, b bigint").distinct()
        found = scratch.save(found)
        scratch.release()
        x, y = self.classes.alias("x"), self.classes.alias("y")
        shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
        na, nb = F.size("x.tokens"), F.size("y.tokens")
        self.pairs = scratch.save(
            found.join(x, F.col("a") == F.col("x.cid"))
            .join(y, F.col("b") == F.col("y.cid"))
            .select("a", "b", shared.alias("shared"), na.alias("na"), nb.alias("nb"))
            .where(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num)
        )
        scratch.drop(found)
        if heavy is not None:
            heavy.unpersist()

    def links(self) -> DataFrame:
        """Edges ``(a, b)``: similar classes, and every copy to its class."""
        return self.pairs.select("a", "b").unionByName(self.members.where("id <> cid").select(F.col("cid").alias("a"), F.col("id").alias("b")))
