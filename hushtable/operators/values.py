"""Exact order statistics of numeric columns: quantiles, bins made of them, and the Wasserstein distance of two tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, number

#: Parts into which a column's distinct values are dealt; where the cuts lie changes no result.
PARTS = 256


def long_values(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """A row (col, v) for each row and column; values that are missing or not finite take no part."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), number(c).alias("v")) for c in columns])
    return df.select(*more, F.inline(parts)).where("abs(v) < double('inf')")


def placed(rows: DataFrame, **measures: Column) -> DataFrame:
    """Measures by (col, v); `before_*` has their sums over the column's smaller values, `next` the next larger value.

    Values are counted first, so that a hot value is one row. A column's values are then dealt over 256 parts between
    approximate quantiles; the parts' sums add up to where each part begins, so no column is sorted in one task.
    """
    counts = rows.groupBy("col", "v").agg(*[m.alias(k) for k, m in measures.items()])
    cuts = counts.groupBy("col").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 4 * PARTS).alias("_cuts"))
    dealt = counts.join(F.broadcast(cuts), "col")  # a row for each column of the schema
    dealt = dealt.withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("v")))).drop("_cuts")
    over = Window.partitionBy("col").orderBy("_part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("col", "_part").agg(F.min("v").alias("_least"), *[F.sum(k).alias(f"_{k}") for k in measures])
    sums = sums.select("col", "_part", F.lead("_least").over(over).alias("_after"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in measures])
    own = Window.partitionBy("col", "_part").orderBy("v")
    smaller = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(sums), ["col", "_part"])  # at most 256 rows a column
    starts = [(F.col(f"_{k}") + F.coalesce(F.sum(k).over(smaller), F.lit(0))).alias(f"before_{k}") for k in measures]
    return out.select("col", "v", *measures, *starts, F.coalesce(F.lead("v").over(own), "_after").alias("next"))


def quantiles(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k + 1 quantiles 0/k, 1/k, ... of each column, between two values by linear interpolation: (col, i, value).

    A column without values has no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = long_values(df, columns)
    totals = rows.groupBy("col").agg(F.count("*").alias("total"))
    at = placed(rows, n=F.count("*")).join(F.broadcast(totals), "col")  # a row for each column
    rank = lambda i: F.expr("total - 1") * i / k
    mine = F.filter(F.sequence(F.lit(0), F.lit(k)), lambda i: F.floor(rank(i)).between(F.col("before_n"), F.col("before_n") + F.col("n") - 1))
    hit = at.withColumn("i", F.explode(mine))
    above = F.when((F.floor(rank(F.col("i"))) + 1 < F.col("before_n") + F.col("n")) | F.col("next").isNull(), F.col("v")).otherwise(F.col("next"))
    part = rank(F.col("i")) - F.floor(rank(F.col("i")))
    return hit.select("col", "i", F.round(F.col("v") + part * (above - F.col("v")), 9).alias("value"))


def with_quantile_bins(schema: Schema, df: DataFrame, k: int) -> Schema:
    """The schema with each numeric column's edges at the distinct k-quantiles of a table.

    For evaluation only: such edges tell about the rows they come from. A column of fewer than two distinct quantiles
    keeps its edges. At most k + 1 numbers a column come to the driver.
    """
    found: dict[str, set] = {}
    for row in quantiles(df, list(schema.numeric), k).collect():
        found.setdefault(row["col"], set()).add(row["value"])
    return replace(schema, numeric={c: sorted(found[c]) if len(found.get(c, ())) > 1 else e for c, e in schema.numeric.items()})


def wasserstein(real: DataFrame, other: DataFrame, schema: Schema) -> DataFrame:
    """Exact Wasserstein-1 distance of each numeric column, its bounds scaled to [0, 1]: (col, distance).

    All rows take part. The distance is null where one table has no value and the other has; where both lack
    values there is no row.
    """
    both = long_values(real, list(schema.numeric), F.lit(True).alias("mine")).unionByName(long_values(other, list(schema.numeric), F.lit(False).alias("mine")))
    at = placed(both, a=F.count_if("mine"), b=F.count_if(~F.col("mine")))
    totals = both.groupBy("col").agg(F.count_if("mine").alias("ta"), F.count_if(~F.col("mine")).alias("tb"))
    gap = F.abs((F.col("before_a") + F.col("a")) / F.nullif("ta", F.lit(0)) - (F.col("before_b") + F.col("b")) / F.nullif("tb", F.lit(0)))
    width = F.lit(None).cast("double")
    for c, e in schema.numeric.items():
        width = F.when(F.col("col") == c, F.lit(float(e[-1]) - float(e[0]))).otherwise(width)
    step = F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))
    out = at.join(F.broadcast(totals), "col").groupBy("col").agg(F.sum(gap * step).alias("d"))
    return out.select("col", F.round(F.col("d") / width, 9).alias("distance"))
