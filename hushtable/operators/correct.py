"""Give another table's target the released conditional rates, measure the gain, and bound what is left."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, text
from hushtable.operators.counts import cell_key, cell_rates, coerce
from hushtable.operators.ledger import Ledger, laplace
from hushtable.operators.ranks import ranked, unit_hash


def one_level(schema: Schema, columns: tuple[str, ...]) -> Schema:
    wrong = [c for c in columns if c == schema.target or (c not in schema.numeric and c not in schema.categorical)]
    if not columns or wrong:
        raise ValueError(f"not columns to condition on: {', '.join(wrong) or 'none given'}")
    return replace(schema, levels=(tuple(columns),))


def with_cell(df: DataFrame, schema: Schema, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumn("cell", cell_key(schema, columns))


def conditional_table(df: DataFrame, schema: Schema, columns: tuple[str, ...], epsilon: float, n_min: int = 150, ledger: Ledger | None = None, seed: int | None = None) -> DataFrame:
    """Noisy supports and positive rates (cell, support, rate) of the cells whose noisy support is at least n_min.

    Rows with a missing number are in no cell, as in the release. A twentieth of the budget goes to supports, the rest to positive counts. Only counts over the public domain come to
    the driver. Noise is drawn once, so that no recomputation draws anew.
    """
    if n_min < 50:
        raise ValueError("n_min must be at least 50")
    ledger = ledger or Ledger(epsilon)
    scales = ledger.spend("supports", 0.05 * epsilon), ledger.spend("rates", 0.95 * epsilon)
    rows = cell_rates(coerce(df, schema), one_level(schema, columns)).select("cell", "support", "positives").orderBy("cell").toPandas()
    support = rows["support"] + laplace(scales[0], len(rows), seed)
    positives = rows["positives"] + laplace(scales[1], len(rows), None if seed is None else seed + 1)
    rows["rate"] = np.clip(np.maximum(positives, 0) / np.maximum(support, n_min), 0, 1).round(5)
    rows["support"] = np.maximum(support.round(), n_min).astype(int)
    kept = rows[support >= n_min]
    if not len(kept):
        raise ValueError("no cell has enough rows")
    return df.sparkSession.createDataFrame(kept[["cell", "support", "rate"]])


def relabel(synthetic: DataFrame, table: DataFrame, schema: Schema, columns: tuple[str, ...], ids: list[str], seed: int = 0) -> DataFrame:
    """In each released cell, exactly rate * n rows get the positive label (a fraction is rounded at random); which ones is random.

    Rows of other cells keep their label. `table` has columns cell, rate; ids tell rows apart.
    """
    own = one_level(schema, columns)
    rows = ranked(with_cell(synthetic, own, columns), ["cell"], ids, seed).join(F.broadcast(table.select("cell", "rate")), "cell", "left")
    exact = F.col("rate") * F.col("size")
    quota = F.floor(exact) + (unit_hash(F.concat("cell", F.lit(f"|{seed}"))) < exact - F.floor(exact)).cast("long")
    label = F.when(F.col("rank") < quota, F.lit(schema.positive)).otherwise(F.lit(schema.negative))
    return rows.withColumn(schema.target, F.when(F.col("rate").isNull(), F.col(schema.target)).otherwise(label)).select(*synthetic.columns)


def table_error(df: DataFrame, table: DataFrame, schema: Schema, columns: tuple[str, ...]) -> float | None:
    """Mean absolute difference between a table's positive rates and the released ones; None without a common cell."""
    rows = with_cell(df, schema, columns).groupBy("cell").agg(F.avg((text(schema.target) == schema.positive).cast("double")).alias("p"))
    return rows.join(F.broadcast(table), "cell").agg(F.avg(F.abs(F.col("p") - F.col("rate")))).first()[0]


def gain(before: DataFrame, after: DataFrame, table: DataFrame, schema: Schema, columns: tuple[str, ...]) -> dict:
    """Conditional error before and after; worth the while if it falls by more than 0.02."""
    a, b = (table_error(df, table, schema, columns) for df in (before, after))
    fall = None if a is None or b is None else a - b
    return {"before": a, "after": b, "reduction": fall, "worth_it": fall is not None and fall > 0.02}


def bounds(private: DataFrame, conditions: dict[str, DataFrame], table: DataFrame, schema: Schema, columns: tuple[str, ...], epsilon: float, n_min: int = 150, alpha: float = 0.05, ledger: Ledger | None = None, seed: int | None = None) -> DataFrame:
    """How far each condition's rate may be from the private one in every released cell, with probability 1 - alpha.

    All conditions are scored on one noisy draw, one query for each of the disjoint cells. A cell that a condition lacks has
    the bound 1; under 20 rows it is thin. Private cell sizes are not returned. Returns condition, cell, bound, thin.
    """
    if epsilon <= 0 or not conditions:
        raise ValueError("a positive budget and a condition are needed")
    own = one_level(schema, columns)
    scale = (ledger or Ledger(epsilon)).spend("bound", epsilon)
    cells = cell_rates(coerce(private, schema), own).join(F.broadcast(table.select("cell")), "cell").select("cell", "support", "positives").orderBy("cell").toPandas()
    if not len(cells):
        raise ValueError("no released cell")
    rate = (cells["positives"] + laplace(scale, len(cells), seed)) / np.maximum(cells["support"], n_min)
    half = math.log(len(cells) / alpha) / (n_min * epsilon)
    spark = private.sparkSession
    noisy = spark.createDataFrame(list(zip(cells["cell"], np.clip(rate, 0, 1).tolist())), "cell string, q double")
    out = None
    for name, df in conditions.items():
        have = with_cell(df, own, columns).groupBy("cell").agg(F.count("*").alias("n"), F.avg((text(schema.target) == schema.positive).cast("double")).alias("p"))
        one = noisy.join(have, "cell", "left").select(F.lit(name).alias("condition"), "cell", F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(F.least(F.abs(F.col("p") - F.col("q")) + half, F.lit(1.0))).alias("bound"), F.coalesce(F.col("n") < 20, F.lit(False)).alias("thin"))
        out = one if out is None else out.unionByName(one)
    return out


def verdict(scored: DataFrame, tolerance: float, synthetic: str = "synthetic", ceiling: str = "ceiling", floor: str = "floor") -> bool | None:
    """Whether the synthetic table's worst bound is within tolerance; None where the controls say that the test can't tell."""
    rows = {r["condition"]: r for r in scored.groupBy("condition").agg(F.max("bound").alias("worst"), F.max("thin").alias("thin")).collect()}
    if any(rows[c]["thin"] for c in (synthetic, ceiling, floor)) or rows[ceiling]["worst"] > tolerance or rows[floor]["worst"] <= tolerance:
        return None
    return rows[synthetic]["worst"] <= tolerance
