"""Filling containers of fixed capacity with items of varying size.

Bounded-space online packing: every partition keeps a fixed number of open containers, puts each
item into the fullest open container that still takes it, and emits the fullest one when none
does. What is open at a partition's end is merged the same way over ever fewer partitions, whole
containers being the items. Only an item larger than the capacity is cut, into consecutive pieces.

Items with a null or no size are left out. One row per piece: ``(doc_id, piece_no, container)``,
``piece_no`` from 0.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import staged

OPEN = 256
#: Leftover containers that one task merges in the last step.
LAST = 200_000


class Packer:
    """Open containers in order of what they hold; best fit is one binary search."""

    def __init__(self, capacity: int, open_: int, first_id: int):
        self.capacity, self.open, self.next = capacity, open_, first_id
        self.held: list[tuple[int, int]] = []

    def place(self, size: int) -> int:
        at = bisect.bisect_right(self.held, (self.capacity - size, 1 << 62)) - 1
        if at >= 0:
            load, container = self.held.pop(at)
        else:
            if len(self.held) >= self.open:
                self.held.pop()
            load, container, self.next = 0, self.next, self.next + 1
        if load + size < self.capacity:
            bisect.insort(self.held, (load + size, container))
        return container


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece_no, size)``: items over the capacity are cut."""
    n = F.col("n_tokens").cast("long")
    cut = sizes.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity).cast("long"))).alias("piece_no"))
    return cut.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece_no") * capacity).alias("size"))


def _pack(batches: Iterator[pd.DataFrame], capacity: int, open_: int) -> Iterator[pd.DataFrame]:
    """Adds ``container`` to rows with a ``size``; ids are unique by partition."""
    packer = Packer(capacity, open_, TaskContext.get().partitionId() << 40)
    for b in batches:
        yield b.assign(container=pd.array([packer.place(int(s)) for s in b["size"]], dtype="int64"))


def pack(sizes: DataFrame, capacity: int = 2048, open_: int = OPEN) -> DataFrame:
    """Containers for items ``(doc_id, n_tokens)``."""
    packed = staged(pieces_of(sizes, capacity).mapInPandas(lambda it: _pack(it, capacity, open_), "doc_id long, piece_no int, size long, container long"), "packed")
    loads = packed.groupBy("container").agg(F.sum("size").alias("size")).filter(F.col("size") < capacity)
    # at most OPEN containers of a partition are worth merging: the emptiest
    from pyspark.sql import Window

    part = F.shiftrightunsigned("container", 40)
    rank = F.row_number().over(Window.partitionBy(part).orderBy("size", "container"))
    left = staged(loads.withColumn("rank", rank).filter(F.col("rank") <= open_).select("container", "size"), "leftover")
    count, moves, step = left.count(), None, 0
    while count:
        tasks = max(1, count // LAST)
        ordered = left.repartition(tasks, F.xxhash64("container")).sortWithinPartitions(F.desc("size"), "container")
        first = -(step + 1) << 58
        merged = staged(
            ordered.mapInPandas(lambda it: _pack((b.rename(columns={"container": "old"}) for b in it), capacity, max(open_, LAST)), "old long, size long, container long")
            .select("old", "size", (F.col("container") + F.lit(first)).alias("container")), "merged")
        moves = merged.select("old", F.col("container").alias("new")) if moves is None else (
            moves.join(merged.select(F.col("old").alias("new"), F.col("container").alias("_c")), "new", "left").select("old", F.coalesce("_c", "new").alias("new")))
        if tasks == 1:
            break
        step += 1
        sums = merged.groupBy("container").agg(F.sum("size").alias("size"))
        rank = F.row_number().over(Window.partitionBy(F.pmod("container", F.lit(tasks))).orderBy("size", "container"))
        left = staged(sums.withColumn("rank", rank).filter((F.col("rank") <= open_) & (F.col("size") < capacity)).select("container", "size"), "leftover")
        count = left.count()
    if moves is None:
        return packed.select("doc_id", "piece_no", "container")
    joined = packed.join(moves.withColumnRenamed("old", "container"), "container", "left")
    return joined.select("doc_id", "piece_no", F.coalesce("new", "container").alias("container"))
