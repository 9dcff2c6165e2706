"""Problem 7: filling containers of fixed capacity.

Hierarchical residual packing. Every task packs the items it has by best fit, largest first, and emits
the containers that are nearly full. The rest become items themselves (with their members) and meet in
the next round in fewer tasks, `fan_in` at a time and never more than `items_per_task` in one, until one task has
packed all that is left or a round of few tasks merges hardly anything. An item over the capacity is cut into full
containers; what remains of it is packed like any other. Items of size null or < 1 are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
NEARLY_FULL = 0.995
ITEMS_PER_TASK = 100_000
FAN_IN = 8


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each container: best fit in decreasing order, ties by index.

    Open containers are kept by free space; bit f of `free` says whether one with f to spare exists, so
    the tightest that takes an item is the lowest set bit from its size up.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    free = 0
    for i in order:
        size = sizes[i]
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_free[room].pop()
            if not by_free[room]:
                free &= ~(1 << room)
            bins[at].append(i)
            room -= size
        else:
            at, room = len(bins), capacity - size
            bins.append([i])
        if room:
            by_free.setdefault(room, []).append(at)
            free |= 1 << room
    return bins


def _round(capacity: int, full: float, per_task: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pack(held: list[pd.DataFrame]) -> pd.DataFrame:
            items = pd.concat(held, ignore_index=True).sort_values(["size", "first"], ascending=[False, True], kind="stable", ignore_index=True)
            sizes, members, first = items["size"].tolist(), items["members"].tolist(), items["first"].tolist()
            bins = best_fit(sizes, capacity)
            rows = [(min(first[i] for i in b), total := sum(sizes[i] for i in b), [m for i in b for m in members[i]], total >= full * capacity) for b in bins]
            return pd.DataFrame(rows, columns=["first", "size", "members", "done"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= per_task:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, items_per_task: int = ITEMS_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """(bin_id, id, part, size): the container of every item; part counts the pieces of an item over the capacity.

    bin_id is that of the container's least member, as "id:part". Each part is in one container, and no
    container holds more than its capacity. Ids have to be unique and not null.
    """
    whole = F.floor((F.col("size") - 1) / capacity).cast("int")
    parts = df.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("int").alias("size")).where("size >= 1 and id is not null")
    parts = parts.select("id", F.explode(F.transform(F.sequence(F.lit(0), whole), lambda k: F.struct(k.cast("int").alias("part"), F.least(F.lit(capacity), F.col("size") - k * capacity).alias("n")))).alias("p"))
    item = F.struct("id", F.col("p.part").alias("part"), F.col("p.n").alias("n"))
    items = parts.select(F.struct("id", F.col("p.part").alias("part")).alias("first"), F.col("p.n").alias("size"), F.array(item).alias("members"))
    # the key sorts like (id, part) and is cheap to handle in Python
    items = items.withColumn("first", F.format_string("%020d:%08d", F.col("first.id"), F.col("first.part")))
    schema = "first string, size int, members array<struct<id:bigint,part:int,n:int>>"
    result = None
    tasks = left = None
    while True:
        packed = cut(items.mapInPandas(_round(capacity, nearly_full, items_per_task), schema + ", done boolean"))
        done, rest = packed.where("done").drop("done"), packed.where("not done").drop("done")
        was, left = left, rest.count()
        over = left == 0 or tasks == 1 or (was is not None and left > 0.98 * was and tasks <= math.ceil(left / items_per_task))
        kept = packed.drop("done") if over else done
        result = kept if result is None else result.unionByName(kept)
        if over:
            break
        tasks = max(1, math.ceil(left / items_per_task), math.ceil((tasks or packed.rdd.getNumPartitions()) / fan_in))
        items = rest.repartition(tasks, F.xxhash64("first"))
    flat = result.select("first", F.explode("members").alias("m"))
    name = F.concat(F.split("first", ":")[0].cast("long").cast("string"), F.lit(":"), F.split("first", ":")[1].cast("int").cast("string"))
    return flat.select(name.alias("bin_id"), F.col("m.id").alias(id_col), F.col("m.part").alias("part"), F.col("m.n").alias("size"))
