"""Exact ranks, samples and quotas in a random but repeatable order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(ids: list[str], seed: int) -> Column:
    """A hexadecimal hash of a row's ids and a seed; DuckDB's md5 gives the same."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))).cast("binary"))


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) that depends on a text alone."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def ranked(df: DataFrame, keys: list[str], ids: list[str], seed: int) -> DataFrame:
    """Adds `rank` (from 0, in hash order) and `size` of each row's group; keys must not be null.

    A group is dealt over 4096 beginnings of the hash: their counts, summed up, give each part's first rank, so that a hot
    group is never sorted in one task. Rows that share their ids are told apart in no defined order.
    """
    rows = df.withColumn("_hash", order_key(ids, seed)).withColumn("_part", F.substring("_hash", 1, 3))
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    before = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_first"), F.sum("_n").over(every).alias("size"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_hash", *ids)) - 1
    out = rows.join(firsts, [*keys, "_part"]).withColumn("rank", F.col("_first") + own)
    return out.select(*df.columns, "rank", "size")


def sample_exactly(df: DataFrame, n: int, ids: list[str], seed: int) -> DataFrame:
    """Exactly n rows, or all if there are fewer, without replacement: the n first by hash, which each task picks from its own."""
    return df.orderBy(order_key(ids, seed), *ids).limit(n)


def holdout_split(df: DataFrame, by: str, fraction: float, ids: list[str], seed: int) -> DataFrame:
    """Adds `held_out`: exactly floor(fraction * size) rows of each value of `by`. Rows with a null value are one group."""
    keyed = df.withColumn("_by", F.coalesce(F.col(by).cast("string"), F.lit("")))
    out = ranked(keyed, ["_by"], ids, seed)
    return out.withColumn("held_out", F.col("rank") < F.floor(F.col("size") * fraction)).select(*df.columns, "held_out")


def apportion(shares: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """Integer `quota` in proportion to weights, adding up to n: largest remainders first, ties to the smaller key.

    For small public tables such as cohort sizes; weights must not be negative and some must be positive.
    """
    total = Window.partitionBy()
    exact = shares.withColumn("_exact", F.col(weight) * n / F.sum(weight).over(total))
    floors = exact.withColumn("_floor", F.floor("_exact")).withColumn("_short", n - F.sum(F.floor("_exact")).over(total))
    place = F.row_number().over(Window.orderBy((F.col("_floor") - F.col("_exact")).asc(), F.col(key)))
    return floors.withColumn("quota", F.col("_floor") + (place <= F.col("_short")).cast("long")).select(*shares.columns, "quota")
