"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups, here the rows of equal text, are taken by falling size; each enters the bin of least room that still holds
it, which a balanced tree of rooms finds in logarithmic time. Bins are the shards, of one fixed capacity.

What the packing sees are size classes with the number of groups in each, not the groups: sizes below 65,536 bytes
are a class each, those above share one with sizes up to a thousandth larger. So there are at most 65,536 classes
and 1,024 for each further power of two, whatever the corpus. Groups of one class take the places that the class
was given in the order of their numbers within it. A group beyond the capacity of a shard fits none; it is cut by
row into parts of a 256th of the capacity, and only such a group lies in more than one shard.

Law: `bytes`, sizes near equal. Classes and slots are numbered without a shuffle: each task numbers its own rows,
and the counts of the tasks give the offsets.

Defined cases: a null text has size 8 and shares a group with no empty text; repeated rows are rows of their
own; a null id is like any other; texts are read whole and once; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import small, stash

ROW_BYTES = 8
EXACT_BITS, CLASS_BITS = 16, 10  # sizes of more bits than the first are told apart by the bits of the second
PARTS = 256  # of a capacity, into which a group that fits no shard is cut
HOT_SHARE = 1000  # a group of more than a thousandth of all rows is joined without a shuffle


class Rooms:
    """Bins by the room they have left: a treap, balanced by random ranks, so that it is searched and changed in logarithmic time."""

    def __init__(self):
        self.top, self.rng = None, random.Random(1)

    def put(self, room: float, bin_: int) -> None:
        low, high = self._split(self.top, (room, bin_))
        self.top = self._merge(self._merge(low, [(room, bin_), self.rng.random(), None, None]), high)

    def tightest(self, size: float) -> tuple[float, int] | None:
        """Take out the bin of least room that holds size; None if none does."""
        low, high = self._split(self.top, (size, -1))
        found, high = self._ends(high, 2)
        self.top = self._merge(low, high)
        return found

    def widest(self) -> tuple[float, int]:
        """Take out the bin of most room."""
        found, self.top = self._ends(self.top, 3)
        return found

    def _split(self, node, key):
        """Nodes below the key and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [*node[:3], low], high
        low, high = self._split(node[2], key)
        return low, [*node[:2], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [*low[:3], self._merge(low[3], high)]
        return [*high[:2], self._merge(low, high[2]), high[3]]

    def _ends(self, node, side: int):
        """The first (side 2) or last (side 3) of a tree, and the rest."""
        if node is None:
            return None, None
        if node[side] is None:
            return node[0], node[5 - side]
        found, rest = self._ends(node[side], side)
        node = [*node]
        node[side] = rest
        return found, node


def best_fit(classes: list[tuple[float, int, int]], bins: int, capacity: float) -> list[tuple[int, int, int, int]]:
    """Places of classes (size, number of groups, key): key, first and last number of the groups, bin. A bin that is the
    tightest stays it while it holds one more, so a class takes a step for each bin that it fills, not for each group.
    Where no bin holds a group, it enters the one of most room."""
    rooms, out = Rooms(), []
    for b in range(bins):
        rooms.put(capacity, b)
    for size, n, key in sorted(classes, key=lambda x: (-x[0], x[2])):
        first = 0
        while first < n:
            found = rooms.tightest(size)
            room, b = found or rooms.widest()
            k = min(n - first, max(1, int(room // size))) if found else 1
            rooms.put(room - k * size, b)
            out.append((key, first, first + k - 1, b))
            first += k
    return out


def fewest_bins(sizes: list[tuple[float, object]], capacity: float) -> dict[object, int]:
    """Best fit into as many bins of the capacity as are needed: a new one opens where none has room."""
    rooms, out, n = Rooms(), {}, 0
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        room, b = rooms.tightest(size) or (capacity, n)
        n = max(n, b + 1)
        rooms.put(room - size, b)
        out[key] = b
    return out


def size_class(size: Column) -> Column:
    """The number of a size's class."""
    over = F.length(F.bin(size)) - EXACT_BITS - 1  # powers of two beyond the first size that isn't told exactly
    lead = F.floor(size / F.pow(F.lit(2.0), over + EXACT_BITS - CLASS_BITS)).cast("long")
    return F.when(size < 1 << EXACT_BITS, size).otherwise((1 << EXACT_BITS) + (over - 1) * (1 << CLASS_BITS) + lead).cast("int")


def n_classes(size: int) -> int:
    """How many classes sizes up to this one have."""
    return (1 << EXACT_BITS) + (max(0, size.bit_length() - EXACT_BITS) << CLASS_BITS)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark, text = docs.sparkSession, F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.md5(F.concat(F.coalesce(text, F.lit("")), text.isNull().cast("string"))).alias("grp"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stash(rows, "shard-rows")
    sums = [F.sum("size").alias("size"), F.count("*").alias("n")]
    groups = stash(rows.groupBy("grp").agg(*sums), "shard-groups")
    total, n_rows = groups.agg(F.sum("size"), F.sum("n")).first()
    capacity = -(-(total or 0) // shards)
    cut = groups.where(F.col("size") > capacity)  # fewer than shards, as they are larger than a shard's share
    parts = F.ceil(F.col("size") / F.lit(max(1, capacity)) * PARTS).cast("int").alias("parts")
    rows = rows.join(F.broadcast(cut.select("grp", parts)), "grp", "left")
    unit = F.when(F.col("parts").isNull(), F.col("grp")).otherwise(F.concat_ws("/", "grp", F.pmod(F.xxhash64("row"), F.col("parts"))))
    rows = rows.select("doc_id", "size", "text_crc32", unit.alias("unit"), F.col("parts").isNotNull().alias("cut"))
    pieces = rows.where("cut").groupBy("unit").agg(*sums)
    units = groups.where(F.col("size") <= capacity).select(F.col("grp").alias("unit"), "size", "n").unionByName(pieces)
    units = number(units.withColumn("class", size_class(F.col("size"))), "class", n_classes(total or 0), "place")
    classes = [(float(r["size"]), r["k"], r["class"]) for r in units.groupBy("class").agg(F.avg("size").alias("size"), F.count("*").alias("k")).collect()]
    places = best_fit(classes, shards, capacity)
    lookup = spark.createDataFrame(places or [(0, 0, 0, 0)], "class int, first long, last long, shard int")
    units = units.join(F.broadcast(lookup), "class").where("place between first and last").select("unit", "n", "shard")  # a row or a few for each class
    units = stash(units, "shard-units")
    hot = F.col("n") * HOT_SHARE > (n_rows or 0)
    often = F.broadcast(units.where(hot).drop("n"))  # fewer than HOT_SHARE, as each has more than that share of all rows
    rest = units.where(~hot).drop("n")
    placed = rows.join(often, "unit").unionByName(rows.join(often, "unit", "left_anti").join(small(rest), "unit").select("unit", "doc_id", "size", "text_crc32", "cut", "shard"))
    return number(placed.select("doc_id", "size", "text_crc32", "shard"), "shard", shards)


def number(rows: DataFrame, by: str, n: int, out: str = "slot") -> DataFrame:
    """rows with a long column `out`, gapless from 0 within each value 0 to n-1 of the column `by`; no shuffle of the rows."""
    names = rows.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(n, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(names.index(by)).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=n)
            slot = np.empty(len(own), np.int64)
            slot[order] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot += seen[own]
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot), pa.array(np.full(len(own), task, np.int32))], names=[*names, out, "task"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} long, task int"
    kept = stash(rows.mapInArrow(local, schema), "numbered")
    before = Window.partitionBy(by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(by, "task").agg(F.count("*").alias("n"))
    offsets = counts.select(by, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return kept.join(small(offsets), [by, "task"]).select(*names, (F.col(out) + F.col("before")).alias(out))
