"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 8).

Rows of equal text form a group that stays in one shard. Groups are taken by size, largest first;
each enters the bin with the tightest remaining capacity that still holds it (lowest bin at a tie),
found in a balanced tree over (remaining, bin). Once a bin is the tightest it stays so while it is
filled, until a group no longer fits or sizes have come down to what a fuller bin has left. So the packing
goes by stretches of groups in place of single groups: the end of a stretch is a binary search in running sums over the
histogram of group sizes, and a plan is as long as the number of stretches, a few for each bin. The
histogram has at most sqrt(2 * total bytes) rows, since that many distinct sizes already add up to the total; it comes
to the driver as two arrays of numbers, while groups and rows never leave the executors.

`pack` minimises shards of a fixed capacity. `pack_into` searches the smallest capacity with which
best-fit-decreasing needs at most n shards. A group larger than an even share can't be cut: it gets a
shard of its own, and the capacity is searched for the rest in the other shards.

Cases: null text is a text of no bytes (its group is that of the empty text). Rows with repeated or
null ids are kept, each with a slot of its own. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rank buckets within a size, and slot buckets within a shard; more where rows would exceed ROWS_A_BUCKET.
RANK_BUCKETS, SLOT_BUCKETS, ROWS_A_BUCKET = 1024, 256, 500_000
#: Plans over so many cut sizes are joined by shuffle, not broadcast (under 40 MB at that size).
BROADCAST_ROWS = 500_000


class Tree:
    """An AA tree: a balanced search tree of (remaining, bin) keys with least-key-from search."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # a node is [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = cut(t[2], key)
            elif t[0] < key:
                t[3] = cut(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            elif t[2] is None:
                near = t[3]
                while near[2]:
                    near = near[2]
                t[0] = near[0]
                t[3] = cut(t[3], near[0])
            else:
                near = t[2]
                while near[3]:
                    near = near[3]
                t[0] = near[0]
                t[2] = cut(t[2], near[0])
            low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
            if low < t[1]:
                t[1] = low
                if t[3] and low < t[3][1]:
                    t[3][1] = low
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def least_from(self, key):
        """The least key that is `key` or above, or None."""
        t, best = self.root, None
        while t:
            if t[0] < key:
                t = t[3]
            else:
                best, t = t[0], t[2]
        return best

    def greatest_below(self, key):
        """The greatest key below `key`, or None."""
        t, best = self.root, None
        while t:
            if t[0] < key:
                best, t = t[0], t[3]
            else:
                t = t[2]
        return best


class Histogram:
    """Distinct group sizes, largest first, the number of groups of each, and running sums of their bytes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
        self.sizes, self.counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
        self.sums = np.concatenate([[0], np.cumsum(self.sizes * self.counts)])

    @classmethod
    def of(cls, pairs: Iterable[tuple[int, int]]) -> Histogram:
        pairs = list(pairs)
        return cls(np.array([s for s, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64))

    def __len__(self) -> int:
        return len(self.sizes)

    def after(self, size: int) -> int:
        """Index of the first size of `size` or less."""
        return int(np.searchsorted(-self.sizes, -size, "left"))


#: A stretch of groups in one bin: from rank `first` of size index `at` up to, not including, rank `end` of size index `to`.
Stretch = tuple[int, int, int, int, int]  # at, first, to, end, bin


def best_fit(h: Histogram, capacity: int, bins: int | None = None, start: tuple[int, int] = (0, 0)) -> list[Stretch] | None:
    """Best-fit-decreasing of the groups from `start` (size index, rank) on; None if over `bins` bins are needed.

    Sizes are positive and at most the capacity.
    """
    tree, out, used = Tree(), [], 0
    i, rank = start
    while i < len(h):
        size = int(h.sizes[i])
        found = tree.least_from((size, -1))
        if found is None:
            if used == bins:
                return None
            found, used = (capacity, used), used + 1
        else:
            tree.remove(found)
        left, at = found
        fuller = tree.greatest_below((size, -1))
        stop = len(h) if fuller is None else h.after(fuller[0])  # from here on a fuller bin is tighter
        begin = (i, rank)
        n = min(int(h.counts[i]) - rank, left // size)
        left, rank = left - n * size, rank + n
        if rank == h.counts[i]:
            i, rank = i + 1, 0
            if i < stop:
                to = min(stop, int(np.searchsorted(h.sums, h.sums[i] + left, "right")) - 1)
                left, i = left - int(h.sums[to] - h.sums[i]), to
                if i < stop:
                    rank = left // int(h.sizes[i])
                    left -= rank * int(h.sizes[i])
        out.append((*begin, i, rank, at))
        if left:
            tree.add((left, at))
    return out


def plan_into(h: Histogram, shards: int) -> list[Stretch]:
    """Stretches over at most `shards` bins with the least capacity that best-fit-decreasing manages."""
    out: list[Stretch] = []
    total, at, i, rank = int(h.sums[-1]), 0, 0, 0
    while i < len(h) and at < shards - 1 and int(h.sizes[i]) * (shards - at) > total:  # over an even share of the rest
        begin, total = (i, rank), total - int(h.sizes[i])
        i, rank = (i, rank + 1) if rank + 1 < h.counts[i] else (i + 1, 0)
        out.append((*begin, i, rank, at))
        at += 1
    if i == len(h):
        return out
    low = max(-(-total // (shards - at)), int(h.sizes[i]))
    high, best, step = low, None, 1
    while best is None:
        best = best_fit(h, high, shards - at, (i, rank))
        if best is None:
            low, high, step = high + 1, high + step, step * 2
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit(h, mid, shards - at, (i, rank))) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return out + [(*stretch, at + k) for *stretch, k in best]


def parts_of(h: Histogram, plan: list[Stretch]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """A plan as (largest size, least size, bin) of sizes that lie whole in a bin, and (size, first rank, end rank, bin) of those that don't."""
    whole, cut = [], []
    for at, first, to, end, k in plan:
        if at == to:
            cut.append((int(h.sizes[at]), first, end, k))
            continue
        if first:
            cut.append((int(h.sizes[at]), first, int(h.counts[at]), k))
            at += 1
        if at < to:
            whole.append((int(h.sizes[at]), int(h.sizes[to - 1]), k))
        if end:
            cut.append((int(h.sizes[to]), 0, end, k))
    return whole, cut


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32 and the group key of every row; texts stay behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))


def _ranked(df: DataFrame, by: str, bucket: Column, order: Iterable[str], out: str) -> DataFrame:
    """A gapless rank from 0 within `by`, by bucket then order: ranks in (by, bucket) plus the sizes of earlier buckets."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_b", (F.sum("_n").over(Window.partitionBy(by).orderBy("_b")) - F.col("_n")).alias("_before"))
    local = df.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)) - 1)
    return local.join(before, [by, "_b"]).withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")


def placed_whole(groups: DataFrame, whole: list[tuple[int, int, int]]) -> DataFrame:
    """key, shard of the groups whose size lies whole in a shard."""
    whole = sorted(whole)
    shared = groups.sparkSession.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*whole, strict=True)) if whole else (np.empty(0, np.int64),) * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, low, shard = shared.value
        for batch in batches:
            size = batch.column(1).to_numpy()
            at = np.searchsorted(top, size, "left")
            inside = at < len(top)
            inside[inside] = low[at[inside]] <= size[inside]
            yield pa.record_batch([batch.column(0).filter(pa.array(inside)), pa.array(shard[at[inside]].astype(np.int32))], names=["key", "shard"])

    return groups.select("key", "group_size").mapInArrow(run, "key string, shard int")


def assign(df: DataFrame, plan: Callable[[Histogram], list[Stretch]], id_col: str = "doc_id", text_col: str = "text", law: str = "bytes") -> DataFrame:
    """Per row: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    rows = written(measured(df, id_col, text_col), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("group_size")), "shard-groups")
    found = groups.groupBy("group_size").agg(F.count("*").alias("n")).toArrow()
    histogram = Histogram(found["group_size"].to_numpy(), found["n"].to_numpy())
    whole, cut = parts_of(histogram, plan(histogram))
    plan_df = spark.createDataFrame(cut, "group_size long, first long, end long, shard int")
    plan_df = F.broadcast(plan_df) if len(cut) <= BROADCAST_ROWS else plan_df
    torn = groups.join(plan_df.select("group_size").distinct(), "group_size", "left_semi")
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(RANK_BUCKETS, int(histogram.counts.sum()) // ROWS_A_BUCKET))).cast("int")
    ranked = _ranked(torn, "group_size", bucket, ["key"], "rank")
    torn = ranked.join(plan_df, "group_size").where("rank >= first and rank < end").select("key", "shard")
    placed = written(rows.join(placed_whole(groups, whole).unionByName(torn), "key").select("id", "size", "text_crc32", "shard"), f"shard-placed-{uuid.uuid4().hex[:4]}")
    n_rows = placed.count()
    bucket = F.pmod(F.xxhash64("id", "text_crc32"), F.lit(max(SLOT_BUCKETS, n_rows // ROWS_A_BUCKET))).cast("int")
    slotted = _ranked(placed, "shard", bucket, ["id", "text_crc32", "size"], "slot")
    return slotted.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pack_into(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return assign(df, lambda histogram: plan_into(histogram, shards), id_col, text_col)


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of a fixed capacity, as few as best-fit-decreasing needs; a group over the capacity fills a shard alone."""

    def plan(h: Histogram) -> list[Stretch]:
        first = h.after(capacity)  # sizes before it are over the capacity
        out = best_fit(h, capacity, None, (first, 0))
        at = max((k for *_, k in out), default=-1) + 1
        for i in range(first):
            n = int(h.counts[i])
            out += [(i, r, *((i, r + 1) if r + 1 < n else (i + 1, 0)), at + r) for r in range(n)]
            at += n
        return out

    return assign(df, plan, id_col, text_col)
