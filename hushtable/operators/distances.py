"""Distances of higher order between two tables, conditional rates by group, and copies of private rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, cell_bin, clipped, text
from hushtable.operators.counts import _distance, cell_key, dealt


def workload_bin(column: str, schema: Schema) -> Column:
    """A missing number counts as the lowest bound, others are clipped; a missing text is the category `nan`."""
    if column in schema.numeric:
        edges = schema.numeric[column]
        return cell_bin(F.coalesce(clipped(column, edges), F.lit(float(edges[0]))), edges).cast("string")
    return F.coalesce(text(column), F.lit("nan"))


def k_way_distance(real: DataFrame, other: DataFrame, schema: Schema, k: int) -> DataFrame:
    """Total variation of every set of k columns, the target among them, their mean, and the mean of those with the target.

    One pass over each table for all sets.
    """
    names = [*schema.numeric, *schema.categorical, schema.target]
    if not 1 <= k <= len(names):
        raise ValueError(f"k must be from 1 to {len(names)}")
    target = F.array_contains(F.split("col", r"\|"), schema.target)
    return _distance(dealt(real, other, {c: workload_bin(c, schema) for c in names}, list(combinations(names, k))), {"mean": F.lit(True), "mean with target": target})


def conditional_distance(real: DataFrame, other: DataFrame, schema: Schema, columns: tuple[str, ...], least: int = 30) -> DataFrame:
    """Difference of positive rates in groups of at least `least` real rows, and each group's share of those rows.

    A group that the other table lacks counts with the whole real rate. Returns cell, weight, distance.
    """
    if not columns:
        raise ValueError("name at least one column")
    key = cell_key(schema, columns).alias("cell")
    positive = F.count_if(text(schema.target) == schema.positive)
    a = real.groupBy(key).agg(F.count("*").alias("n"), (positive / F.count("*")).alias("p")).where(F.col("n") >= least)
    b = other.groupBy(key).agg((positive / F.count("*")).alias("q"))
    total = a.agg(F.sum("n").alias("total"))
    out = a.join(b, "cell", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("cell", F.round(F.col("n") / F.col("total"), 9).alias("weight"), F.round(F.abs(F.col("p") - F.coalesce("q", F.lit(0.0))), 9).alias("distance"))


def exact_matches(private: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the other table that equal a private row in all columns; nulls equal nulls.

    Both sides meet on a hash of the columns, made distinct first, so a row with many private copies is one partner.
    """
    key = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    members = private.select(key.alias("_key")).distinct()
    return other.withColumn("_key", key).join(members, "_key", "left_semi").select(*other.columns)


def pool_coverage(pool: DataFrame, sizes: DataFrame, cohort: str, n: int) -> DataFrame:
    """How many rows each cohort owes to a selection of n, how many the pool has, and their ratio (null if none is owed).

    `sizes` has columns cohort, size.
    """
    have = pool.groupBy(text(cohort).alias("cohort")).agg(F.count("*").alias("have"))
    total = sizes.agg(F.sum("size").alias("total"))
    out = sizes.crossJoin(F.broadcast(total)).join(have, "cohort", "left").na.fill(0, ["have"])  # one row
    owed = F.col("size") * n / F.col("total")
    return out.select("cohort", F.round(owed, 6).alias("owed"), "have", F.when(owed > 0, F.round(F.col("have") / owed, 6)).alias("ratio"))
