"""Errors over stated or drawn workloads of column sets."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators.distances import workload_bin


def target_sets(names: list[str], target: str, k: int = 3) -> list[tuple[str, ...]]:
    """All sets of k columns with the target first."""
    return [(target, *s) for s in combinations([c for c in names if c != target], k - 1)]


def skewed_sets(names: list[str], n: int = 256, k: int = 3, seed: int = 0) -> list[tuple[str, ...]]:
    """n different sets of k columns (all there are, if fewer), in which some columns come up far more often than others.

    A column's weight is a squared normal number. A set is drawn without replacement: the k columns with the least of
    exponential numbers divided by weights, which is what drawing one after the other comes to.
    """
    rng = np.random.default_rng(seed)
    weight = np.maximum(rng.normal(size=len(names)) ** 2, 1e-6)
    found: dict[tuple[str, ...], None] = {}
    most = min(n, comb(len(names), k))
    while len(found) < most:
        for keys in rng.exponential(size=(4 * n, len(names))) / weight:
            found.setdefault(tuple(names[i] for i in sorted(np.argsort(keys)[:k])))
        if len(found) < most:  # what light columns make up is slow to come: flatten the weights a little
            weight = np.sqrt(weight)
    return list(found)[:most]


def workload_error(real: DataFrame, other: DataFrame, schema: Schema, workloads: dict[str, list[tuple[str, ...]]], weights: dict[str, list[float]] | None = None) -> DataFrame:
    """The weighted mean over each workload's sets of the summed difference of shares (twice the total variation):
    (workload, sets, error).

    Rows of each table are counted once by the bins of all columns that any workload names; sets are dealt these counts.
    """
    every = list(dict.fromkeys(s for sets in workloads.values() for s in sets))
    columns = list(dict.fromkeys(c for s in every for c in s))
    place = {c: f"_{i}" for i, c in enumerate(columns)}
    side = lambda df, mine: df.select(*[workload_bin(c, schema).alias(place[c]) for c in columns]).withColumn("mine", F.lit(mine))
    both = side(real, True).unionByName(side(other, False)).groupBy(*place.values()).agg(F.count_if("mine").alias("a"), F.count_if(~F.col("mine")).alias("b"))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.concat_ws("|", *[place[c] for c in s]).alias("bin")) for i, s in enumerate(every)])
    cells = both.select(F.explode(parts).alias("p"), "a", "b").groupBy("p.i", "p.bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    apart = cells.join(F.broadcast(sizes)).groupBy("i").agg(F.sum(F.abs(share("a", "na") - share("b", "nb"))).alias("d"))  # with one row
    rows = [(name, every.index(s), float(w)) for name, sets in workloads.items() for s, w in zip(sets, (weights or {}).get(name) or [1.0] * len(sets))]
    named = real.sparkSession.createDataFrame(rows, "workload string, i int, weight double")
    return apart.join(F.broadcast(named), "i").groupBy("workload").agg(F.count("*").alias("sets"), F.round(F.sum(F.col("weight") * F.col("d")) / F.sum("weight"), 9).alias("error"))
