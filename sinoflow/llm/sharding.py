"""Shards of nearly equal size: a minimax contiguous partition of atomic groups.

Rows of equal text are one atomic group. Groups stand in a fixed order (least doc_id, null first, then digest), and a
shard is a run of them. The smallest feasible capacity is found by binary search, checked greedily: each shard takes
groups until the next would not fit. The cut of the first shard is made there, and the search is repeated on what is left
with one shard less, so that late shards do not stay light. A group as large as the mean of what is left is a shard of its
own; these come first, largest first.

The groups never come to the driver. It sees the running total of sizes as a grid of at most ``GRID`` group borders; as
borders between two of them are unknown, each check has a certain answer and an optimistic one. Where they differ, only
the stretches in which a cut may fall are read again on a grid that is finer by far, until the capacity is exact.

A shard's rows are numbered from 0 in the order of (group, doc_id, row). The order is global: the rows are range
partitioned by it, so a group of a third of all rows is spread over partitions, and a row's number is its place in the
partition plus the counts of the partitions before.

Nulls: a null text has no bytes and equals the empty text; a null doc_id comes first. Repeated rows stay rows of their
own. An empty table gives an empty result; with fewer groups than shards the last shards are empty. Further columns are
ignored by ``assign`` and kept by ``write_shards``, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, merged_with, partitions, text_of

#: Borders that the driver holds of one reading (or twice the square of the number of shards); a bound of memory, not of the result.
GRID = 20_000
#: A group of more than this share of all rows is told to the tasks by name, so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
#: Bytes that a row adds to its text's.
ROW_BYTES = 16


class Borders:
    """The known borders of a run of groups (running totals, 0 and the whole included), and the stretches where all are known."""

    def __init__(self, known: list[int], whole: int) -> None:
        self.known, self.whole, self.exact = sorted({0, whole, *known}), whole, []

    def add(self, known: list[int], stretches: list[tuple[int, int]], exact: bool) -> None:
        self.known = list(heapq.merge(self.known, sorted(set(known) - set(self.known))))
        if exact:
            self.exact += stretches

    def floor(self, at: int) -> int:
        """The last known border up to ``at``."""
        return self.known[bisect_right(self.known, at) - 1]

    def optimistic(self, at: int) -> int:
        """The last place up to ``at`` where a border may be."""
        sure = self.floor(at)
        return sure if sure == at or any(lo <= at < hi for lo, hi in self.exact) else at

    def cuts(self, start: int, capacity: int, shards: int, reach) -> list[int]:
        """The greedy check: where each shard that starts at ``start`` or later ends."""
        out = []
        for _ in range(shards):
            start = max(start, reach(min(start + capacity, self.whole)))
            out.append(start)
        return out

    def smallest(self, start: int, shards: int, reach) -> int:
        """The smallest capacity with which ``shards`` hold everything from ``start`` on."""
        low, high = -(-(self.whole - start) // shards), self.whole - start
        while low < high:
            middle = (low + high) // 2
            if self.cuts(start, middle, shards, reach)[-1] >= self.whole:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, shards: int) -> list[tuple[int, int]]:
        """The stretches to read again: where cuts of the smallest capacity may fall and not all borders are known. Empty: it is exact."""
        low, high = self.smallest(0, shards, self.optimistic), self.smallest(0, shards, self.floor)
        if low == high:
            return []
        early, late = self.cuts(0, low, shards, self.floor), self.cuts(0, high, shards, self.optimistic)
        out: list[tuple[int, int]] = []
        for a, b in zip(early, late, strict=True):
            a, b = self.floor(a), self.known[min(bisect_right(self.known, b), len(self.known) - 1)]
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif a < b:
                out.append((a, b))
        return out

    def even_cuts(self, shards: int) -> list[int]:
        """A cut a shard but the last: at the smallest capacity for what is left, shard by shard."""
        start, out = 0, []
        for left in range(shards, 1, -1):
            start = self.cuts(start, self.smallest(start, left, self.floor), 1, self.floor)[0]
            out.append(start)
        return out


def units_of(docs: DataFrame, row: Column) -> DataFrame:
    """(row, doc_id, size, text_crc32, digest): no text is carried further."""
    raw = text_of().cast("binary")
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"))


def ordered_groups(units: DataFrame, scratch: Scratch, giants: list[bytes]) -> tuple[DataFrame, int]:
    """Groups but the giants as (digest, size, n, start), ``start`` being the running total of sizes before; and the whole."""
    groups = units.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    if giants:
        groups = groups.where(~F.col("digest").isin(giants))
    dealt = groups.repartitionByRange(partitions(scratch.spark), F.col("first").asc_nulls_first(), F.col("digest"))
    placed = scratch.save(dealt.sortWithinPartitions(F.col("first").asc_nulls_first(), "digest").withColumn("place", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, size in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.sum("size")).collect()):  # a row a partition
        offsets.append((p, before))
        before += size
    table = scratch.spark.createDataFrame(offsets, "part long, offset long")
    run = F.sum("size").over(Window.partitionBy("part").orderBy("place"))
    started = placed.withColumn("part", part).withColumn("run", run).join(F.broadcast(table), "part")
    return scratch.save(started.select("digest", "size", "n", (F.col("offset") + F.col("run") - F.col("size")).alias("start")), "starts"), before


def grid_borders(groups: DataFrame, stretches: list[tuple[int, int]], width: int) -> list[int]:
    """The first border of each cell of ``width`` in the stretches (a few dozen, of ``GRID`` cells in all)."""
    inside = F.lit(False)
    for lo, hi in stretches:
        inside = inside | ((F.col("start") >= lo) & (F.col("start") < hi))
    cells = groups.where(inside).groupBy(F.expr(f"start div {width}").alias("cell")).agg(F.min("start").alias("start"))
    return [r["start"] for r in cells.select("start").collect()]


def plan(units: DataFrame, scratch: Scratch, shards: int, grid: int) -> tuple[DataFrame, list[int], list[bytes]]:
    """The groups with their starts, the cuts of the shards after the giants', and the giants' digests, largest first."""
    whole = units.agg(F.sum("size")).first()[0] or 0
    top = units.groupBy("digest").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "digest").limit(shards - 1).collect()
    giants: list[bytes] = []
    for r in top:
        if r["size"] * (shards - len(giants)) < whole:
            break
        giants.append(bytes(r["digest"]))
        whole -= r["size"]
    groups, whole = ordered_groups(units, scratch, giants)
    left = shards - len(giants)
    borders, stretches = Borders([], whole), [(0, whole)] if whole else []
    width = 2 * whole
    while stretches:
        width = max(1, min(width // 2, sum(hi - lo for lo, hi in stretches) // grid))
        borders.add(grid_borders(groups, stretches, width), stretches, width <= ROW_BYTES)  # a group is no smaller: no cell has two
        stretches = borders.unsure(left)
    return groups, borders.even_cuts(left), giants


def assign(docs: DataFrame, shards: int = 40, row: str | None = None, grid: int = GRID) -> DataFrame:
    """One row a document: row, doc_id, size, text_crc32, shard, slot. ``row`` names a column that tells rows apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    units = scratch.save(units_of(docs, F.col(row) if row else F.monotonically_increasing_id()), "units")
    groups, cuts, giants = plan(units, scratch, shards, grid)
    shard = F.lit(len(giants)) + sum((F.col("start") >= c).cast("int") for c in cuts) if cuts else F.lit(len(giants))
    least = max(1, int(units.count() * HOT_SHARE))
    told = groups.select(F.col("digest").alias("_d"), "start", shard.alias("shard"), "n")
    own = [(bytearray(d), k - len(giants), k) for k, d in enumerate(giants)]
    hot = told.where(F.col("n") > least).select("_d", "start", "shard").collect()  # 1 / HOT_SHARE at most
    hot = spark.createDataFrame(own + [tuple(r) for r in hot], "_d binary, start long, shard int")
    on = units["digest"] == F.col("_d")
    marked = units.join(F.broadcast(hot), on, "left")
    few = marked.where("_d is null").select(*units.columns)
    rest = merged_with(few, told.where(F.col("n") <= least).drop("n"), few["digest"] == F.col("_d"))
    columns = ["row", "doc_id", "size", "text_crc32", "start", "shard"]
    both = marked.where("_d is not null").select(*columns).unionByName(rest.select(*columns))
    order = (F.col("shard"), F.col("start"), F.col("doc_id").asc_nulls_first(), F.col("row"))
    dealt = both.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.save(dealt.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    before, offsets = {}, []
    for p, s, n, first in sorted(tuple(r) for r in counts.collect()):  # a row a partition and shard in it
        offsets.append((p, s, before.get(s, 0) - first))
        before[s] = before.get(s, 0) + n
    table = spark.createDataFrame(offsets, "part long, shard int, offset long")
    out = placed.withColumn("part", part).join(F.broadcast(table), ["part", "shard"])
    return out.select("row", "doc_id", "size", "text_crc32", "shard", (at + F.col("offset")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The documents with all their columns under ``path``, a folder ``shard=k`` a shard, each in order of slot in files of consecutive slots."""
    scratch, row = Scratch(docs.sparkSession, "sharded"), free_name(docs, "row")
    rows = scratch.save_bucketed(docs.withColumn(row, F.monotonically_increasing_id()), "rows", row)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    placed = scratch.save(assign(rows, shards, row).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot)), "assigned")
    out = merged_with(rows, placed, row).drop(row)
    out.repartitionByRange(partitions(docs.sparkSession), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
