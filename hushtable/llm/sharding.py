"""Sharding: groups of equal texts, largest first, each into the bin that has the least room left for it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import forget, materialize

#: Sizes of groups keep so many leading bits and are rounded up: sizes under 2 ** BITS are exact, larger ones at most
#: 1 / 2 ** (BITS - 1) too large. So there are at most 2 ** (BITS - 1) different ones for each doubling of the largest
#: group, however many groups there are, and only those and their counts come to the driver.
BITS = 15
#: A group with more than one row in HOT of all is hot; there are fewer than HOT such groups.
HOT = 256


class Room:
    """A balanced tree (a treap) of bins by (room left, number): the tightest bin that still takes a size in log time."""

    def __init__(self):
        self.root, self.state = None, 0x9E3779B9

    def add(self, key: tuple[int, int]) -> None:
        self.state = self.state * 1103515245 + 12345 & 0x7FFFFFFF
        low, high = _split(self.root, key)
        self.root = _merge(_merge(low, [key, self.state, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key with room for a size."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            return None
        path = [high]
        while path[-1][2] is not None:
            path.append(path[-1][2])
        least = path.pop()
        if path:
            path[-1][2] = least[3]
        else:
            high = least[3]
        self.root = _merge(low, high)
        return least[0]


def _split(node, key):
    """Nodes below a key, and the others; a node is [key, priority, left, right]."""
    below, others = [None] * 4, [None] * 4
    low, high = below, others
    while node is not None:
        if node[0] < key:
            low[3] = node
            low, node = node, node[3]
        else:
            high[2] = node
            high, node = node, node[2]
    low[3] = high[2] = None
    return below[3], others[2]


def _merge(low, high):
    top = [None] * 4
    at, side = top, 3
    while low is not None and high is not None:
        if low[1] > high[1]:
            at[side] = low
            at, side, low = low, 3, low[3]
        else:
            at[side] = high
            at, side, high = high, 2, high[2]
    at[side] = low if high is None else high
    return top[3]


@dataclass(frozen=True)
class Plan:
    """Which groups, counted from the largest on, go where: group number `starts[i]` and those up to the next start to `bins[i]`."""

    starts: np.ndarray
    bins: np.ndarray
    used: int
    capacity: int


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int | None = None) -> Plan | None:
    """Best-fit-decreasing over sizes (descending) of which there are so many each; None if it takes more than `most` bins.

    Equal sizes are placed in runs, which gives what placing them one by one would: after a group has gone into the
    tightest bin, that bin is the tightest one still. A group over the capacity gets a bin of its own, its size.
    Ties between bins go to the smaller number.
    """
    room, used, starts, bins, placed = Room(), 0, [], [], 0
    for size, left in zip(sizes.tolist(), counts.tolist()):
        while left:
            found = room.take(size)
            if found is None:
                if used == most:
                    return None
                found, used = (max(capacity, size), used), used + 1
            k = min(left, found[0] // size)
            if not bins or bins[-1] != found[1]:
                starts.append(placed)
                bins.append(found[1])
            placed, left = placed + k, left - k
            room.add((found[0] - k * size, found[1]))
    return Plan(np.array(starts, np.int64), np.array(bins, np.int64), used, capacity)


def least_capacity(sizes: np.ndarray, counts: np.ndarray, shards: int) -> Plan:
    """The plan of the least capacity found, by doubling steps and then bisection, with which best fit takes at most so many bins.

    The search begins at the mean load or the largest group, below which there is none; with twice that there is always
    one, as more bins would leave all of them more than half full.
    """
    total = int((sizes * counts).sum())
    low = high = max(-(-total // shards), int(sizes[0])) if len(sizes) else 1
    step = 1
    while (best := best_fit(sizes, counts, high, shards)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        middle = (low + high) // 2
        found = best_fit(sizes, counts, middle, shards)
        best, low, high = (found, low, middle) if found else (best, middle + 1, high)
    return best


def rounded(size: Column) -> Column:
    """A size rounded up to its BITS leading bits."""
    step = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), step).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def numbered(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, list]:
    """Write rows sorted by (by, order) over range partitions, numbered from 0 within each `by` value.

    Returns the written table with `_at` (partition and row) and a list of (partition, *by, first `_at`, rows), which has a
    row for each value and one more for each partition at most. A hot value is spread over partitions by `order`.
    """
    keys = [*by, *order]
    table = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    return table, table.groupBy(part, *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).collect()


def assigned(groups: DataFrame, capacity: int | None, shards: int | None) -> DataFrame:
    """A shard for each group (digest, rows, bytes), written: digest, rows, shard.

    Groups are sorted by rounded size; their numbers in that order are known from the written partitions, and the plan says
    which numbers go where.
    """
    table, parts = numbered(groups.withColumn("_below", -rounded(F.col("bytes"))), ["_below"], ["digest"])
    parts = sorted(parts, key=lambda r: (r["_below"], r["_part"]))
    values = np.array([-r["_below"] for r in parts], np.int64)
    sizes, at = np.unique(-values, return_index=True)
    counts = np.add.reduceat(np.array([r["_rows"] for r in parts], np.int64), at) if len(parts) else np.zeros(0, np.int64)
    plan = best_fit(-sizes, counts, capacity) if capacity else least_capacity(-sizes, counts, shards)
    rows = np.zeros(1 + max((r["_part"] for r in parts), default=0), np.int64)
    for r in parts:
        rows[r["_part"]] += r["_rows"]
    before = np.cumsum(rows) - rows
    starts, bins = plan.starts, plan.bins

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("_at").to_numpy()
            number = before[at >> 33] + (at & ((1 << 33) - 1))
            shard = bins[np.searchsorted(starts, number, side="right") - 1] if len(bins) else number
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("rows"), pa.array(shard, pa.int32())], names=["digest", "rows", "shard"])

    homes = materialize(table.select("digest", "rows", "_at").mapInArrow(place, "digest binary, rows long, shard int"))
    forget(table)
    return homes


def shard_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = 8, capacity: int | None = None, keep: tuple = ()) -> DataFrame:
    """Every row in a shard, equal texts together: at most `shards` of near equal bytes, or as few as best fit finds with a
    given capacity in bytes.

    A row's size is the bytes of its text and one more. A null text is empty, and goes with the empty ones. Repeated rows
    each count. A group larger than the capacity has a shard to itself. Groups are told apart by the sha256 of their text.
    Rows of an empty table give none. Rows of hot groups (over one in HOT of all) meet their shard by a broadcast of at most
    HOT groups. Returns key, the columns `keep`, size, text_crc32, shard (from 0) and slot (from 0 in each shard, gapless,
    in an order that depends on the texts and ids alone).
    """
    if (shards is None) == (capacity is None) or max(shards or 0, capacity or 0) < 1:
        raise ValueError("give either shards or a capacity, from 1 on")
    known = {"size", "text_crc32", "shard", "slot"}
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("_key"), *kept, (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    rows = materialize(rows)
    groups = rows.groupBy("digest").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    homes = assigned(groups, capacity, shards)
    hot = F.broadcast(homes.where(F.col("rows") * HOT > rows.count()).select("digest", F.col("shard").alias("_hot")))
    spread = rows.join(hot, "digest", "left")
    cold = spread.where("_hot is null").drop("_hot").join(homes.select("digest", "shard"), "digest")
    placed = cold.unionByName(spread.where("_hot is not null").withColumnRenamed("_hot", "shard"))
    placed = placed.withColumn("_mixed", F.xxhash64("digest", "_key"))
    table, parts = numbered(placed.drop("digest"), ["shard"], ["_mixed", "_key"])
    before: dict = {}
    shifts = []
    for r in sorted(parts, key=lambda r: (r["shard"], r["_part"])):
        shifts.append((r["_part"], r["shard"], before.get(r["shard"], 0) - r["_first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["_rows"]
    shift = docs.sparkSession.createDataFrame(shifts, "_part int, shard int, _shift long")
    out = table.withColumn("_part", F.shiftright("_at", 33).cast("int")).join(F.broadcast(shift), ["_part", "shard"])
    forget(rows, homes)
    names = [c if c not in known else f"{c}_input" for c in keep]
    return out.select(F.col("_key").alias(key), *[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)], "size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).alias("slot"))


def write_shards(docs: DataFrame, path: str, text: str = "text", **how) -> None:
    """Write whole rows as Parquet under path/shard=<n>, in the order of their slots; hot shards are written by several tasks."""
    names = [c for c in docs.columns if c != how.get("key", "doc_id")]
    shard_texts(docs, text=text, keep=tuple(names), **how).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
