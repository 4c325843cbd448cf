"""Cluster centres of numbers under a privacy budget: rounds of noisy counts and sums by nearest centre."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import clipped
from hushtable.operators.ledger import laplace, Ledger


def scaled(bounds: dict[str, tuple[float, float]]) -> list[Column]:
    """Numbers clipped to public bounds and scaled to [0, 1]."""
    return [(clipped(c, b) - float(b[0])) / float(b[1] - b[0]) for c, b in bounds.items()]


def nearest_centre(bounds: dict[str, tuple[float, float]], centres: np.ndarray) -> Column:
    """The number of a row's nearest centre (of several the first), null where a number is missing."""
    return _nearest(scaled(bounds), centres)


def _nearest(parts: list[Column], centres: np.ndarray) -> Column:
    apart = F.array(*[sum(((p - float(x)) * (p - float(x)) for p, x in zip(parts, centre)), F.lit(0.0)) for centre in centres])
    return F.array_position(apart, F.array_min(apart)).cast("int") - 1


def noisy_centres(df: DataFrame, bounds: dict[str, tuple[float, float]], k: int, epsilon: float, rounds: int = 6, ledger: Ledger | None = None, start_seed: int = 0, seed: int | None = None) -> np.ndarray:
    """k centres, scaled to [0, 1] by public bounds, from `rounds` of moving each to the noisy mean of its rows.

    The start doesn't depend on rows. A round has an even share of the budget: half for counts, half for sums, divided over
    the columns; a row lies at one centre, so it changes one count and one sum of each column, by 1 at most. Rows with a
    missing number take no part, equal rows are counted once. Each round is one aggregation, of which k * (columns + 1) numbers come to the driver.
    """
    if k < 1 or rounds < 1 or not bounds:
        raise ValueError("a column, a centre and a round are needed")
    ledger = ledger or Ledger(epsilon)
    centres = np.random.default_rng(start_seed).uniform(0.15, 0.85, (k, len(bounds)))
    names = [f"_{i}" for i in range(len(bounds))]
    rows = df.select(*[p.alias(n) for n, p in zip(names, scaled(bounds))]).na.drop().groupBy(*names).agg(F.count("*").alias("_n")).persist()
    for turn in range(rounds):
        at = _nearest([F.col(n) for n in names], centres).alias("at")
        sums = rows.groupBy(at).agg(F.sum("_n"), *[F.sum(F.col(n) * F.col("_n")) for n in names]).collect()
        table = np.zeros((k, len(bounds) + 1))
        for r in sums:
            table[r["at"]] = r[1:]
        draw = lambda scale, n, j: laplace(scale, n, None if seed is None else hash((seed, turn, j)) & 0xFFFFFFFF)
        count = table[:, 0] + draw(ledger.spend(f"counts of round {turn}", epsilon / rounds / 2), k, 0)
        total = table[:, 1:].copy()
        for i in range(len(bounds)):
            total[:, i] += draw(ledger.spend(f"sums of round {turn}", epsilon / rounds / 2 / len(bounds)), k, i + 1)
        centres = np.clip(total / np.maximum(count, 1.0)[:, None], 0, 1)
    rows.unpersist()
    return centres


def clustered(df: DataFrame, bounds: dict[str, tuple[float, float]], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, nearest_centre(bounds, centres))
