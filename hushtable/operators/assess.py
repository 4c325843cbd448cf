"""Whole assessments of a synthetic table: a correction in one call, a bound with its controls, an evaluation with references."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators.audit import marginal_shift
from hushtable.operators.correct import bounds, conditional_table, gain, relabel
from hushtable.operators.counts import absent_categories, one_way_distance, two_way_distance
from hushtable.operators.ledger import check_unit
from hushtable.operators.ranks import ranked, sample_exactly
from hushtable.operators.stage import Release
from hushtable.operators.students import students, STUDENTS

# Sizes up to which a fit on the whole domain was found to end.
MAX_COLUMNS, MAX_ROWS, COLUMNS_FOR_ROWS, MAX_WIDE, WIDE_BINS, COLUMNS_FOR_WIDE = 18, 50_000, 10, 5, 8, 13


def domain_size(schema: Schema) -> int:
    """How many different rows the public domain has, the target counted in."""
    return 2 * math.prod(len(schema.bins(c)) for c in [*schema.numeric, *schema.categorical])


def infeasible(schema: Schema, rows: int | None = None) -> list[str]:
    """Why a fit on the whole domain isn't to be expected to end; an empty list if nothing speaks against it."""
    columns = len(schema.numeric) + len(schema.categorical) + 1
    wide = [c for c in schema.numeric if len(schema.bins(c)) >= WIDE_BINS]
    found = [
        (columns > MAX_COLUMNS, f"{columns} columns, more than {MAX_COLUMNS}"),
        (rows is not None and rows > MAX_ROWS and columns >= COLUMNS_FOR_ROWS, f"{rows} rows with {columns} columns"),
        (len(wide) > MAX_WIDE and columns >= COLUMNS_FOR_WIDE, f"{len(wide)} numeric columns of {WIDE_BINS} bins or more with {columns} columns"),
    ]
    return [why for holds, why in found if holds]


def permuted(df: DataFrame, column: str, ids: list[str], seed: int = 0) -> DataFrame:
    """The same rows with one column's values dealt out anew: the k-th row in one hash order gets the k-th value in another.

    Values, nulls among them, keep their counts; ids must tell rows apart.
    """
    one = df.withColumn("_all", F.lit(0))
    at = ranked(one, ["_all"], ids, seed).drop("size", "_all", column)
    dealt = ranked(one.select(*ids, column, "_all"), ["_all"], ids, seed + 1).select("rank", F.col(column))
    return at.join(dealt, "rank").select(*df.columns)


def tolerance(release: Release, table: DataFrame, epsilon: float, n_min: int = 150, alpha: float = 0.05) -> float:
    """The half width of the bound plus half the greatest released distance of a cell's rate from the base rate."""
    size = release.cohorts["size"]
    base = float((size * release.cohorts["positive_share"]).sum() / max(size.sum(), 1))
    cells, far = table.agg(F.count("*"), F.max(F.abs(F.col("rate") - base))).first()
    return math.log(max(cells, 1) / alpha) / (n_min * epsilon) + 0.5 * (far or 0.0)


def bound_with_controls(private: DataFrame, synthetic: DataFrame, holdout: DataFrame, release: Release, table: DataFrame, schema: Schema, columns: tuple[str, ...], ids: list[str], epsilon: float, rows_per_person: int, n_min: int = 150, alpha: float = 0.05, allowed: float | None = None, seed: int = 0, noise_seed: int | None = None, gate: bool = False) -> dict:
    """The worst bound of the synthetic table beside a real sample (ceiling) and the same sample with its target dealt anew
    (floor), all on one noisy draw.

    The verdict is None unless no synthetic cell is thin, the ceiling passes and the floor fails. A person's budget is the
    release's and this one's, times rows per person; with `gate` over 10 is refused before anything is read.
    """
    if rows_per_person < 1:
        raise ValueError("rows per person must be stated")
    if gate:
        check_unit(release.audit["total"] + epsilon, rows_per_person)
    n = min(synthetic.count(), holdout.count())
    if not n:
        raise ValueError("the synthetic and held-out tables need rows")
    ceiling = sample_exactly(holdout, n, ids, seed)
    conditions = {"synthetic": synthetic, "ceiling": ceiling, "floor": permuted(ceiling, schema.target, ids, seed)}
    scored = bounds(private, conditions, table, schema, columns, epsilon, n_min, alpha, seed=noise_seed)
    worst = {r["condition"]: (r["worst"], r["thin"]) for r in scored.groupBy("condition").agg(F.max("bound").alias("worst"), F.count_if("thin").alias("thin")).collect()}
    limit = tolerance(release, table, epsilon, n_min, alpha) if allowed is None else allowed
    told = worst["ceiling"][0] <= limit < worst["floor"][0]
    spent = release.audit["total"] + epsilon
    return {
        "worst": {k: v[0] for k, v in worst.items()}, "thin_cells": worst["synthetic"][1], "tolerance": limit, "controls_discriminate": told,
        "verdict": None if worst["synthetic"][1] or not told else worst["synthetic"][0] <= limit,
        "epsilon_per_row": spent, "epsilon_per_person": spent * rows_per_person,
    }


def correct(private: DataFrame, synthetic: DataFrame, schema: Schema, columns: tuple[str, ...], ids: list[str], epsilon: float, n_min: int = 150, seed: int = 0, noise_seed: int | None = None) -> tuple[DataFrame, dict]:
    """The synthetic table with released conditional rates, and what that gained; its features don't shift."""
    table = conditional_table(private, schema, columns, epsilon, n_min, seed=noise_seed)
    after = relabel(synthetic, table, schema, columns, ids, seed)
    return after, gain(synthetic, after, table, schema, columns) | {"shift": marginal_shift(synthetic, after, schema).first()["shift"]}


def measures(real: DataFrame, other: DataFrame, schema: Schema) -> DataFrame:
    """Mean one- and two-way distance to the real table and the number of absent declared values: (measure, value)."""
    mean = lambda df, name: df.where("col = 'mean'").select(F.lit(name).alias("measure"), F.col("distance").alias("value"))
    absent = absent_categories(other, schema).agg(F.count("*").cast("double").alias("value")).select(F.lit("absent values").alias("measure"), "value")
    parts = [mean(one_way_distance(real, other, schema), "one-way distance"), mean(two_way_distance(real, other, schema), "two-way distance"), absent]
    return reduce(DataFrame.unionByName, parts)


def evaluate(tables: dict[str, DataFrame], train: DataFrame, holdout: DataFrame, schema: Schema, ids: list[str], n: int, seed: int = 1000, draws: int = 5, names: tuple[str, ...] = STUDENTS) -> DataFrame:
    """Distances to training rows, absent values, and areas under the curve of students judged on held-out rows, of each table.

    References beside the tables: `real`, samples of n training rows, and `permuted`, the same with the target dealt anew,
    each drawn `draws` times. Returns (table, measure, mean, least, most); a given table has one value a measure.
    """
    if set(tables) & {"real", "permuted"}:
        raise ValueError("real and permuted are names of the references")
    judged = list(tables.items())
    for k in range(draws):
        sample = sample_exactly(train, n, ids, seed + k)
        judged += [("real", sample), ("permuted", permuted(sample, schema.target, ids, seed + k))]
    rows = []
    for name, df in judged:
        parts = measures(train, df, schema)
        if names:
            areas = students(df, holdout, schema, seed, names)
            parts = parts.unionByName(areas.select(F.concat(F.lit("area of "), "student").alias("measure"), F.col("auc").alias("value")))
        rows.append(parts.withColumn("table", F.lit(name)))
    every = reduce(DataFrame.unionByName, rows).groupBy("table", "measure")
    return every.agg(*[F.round(f("value"), 9).alias(to) for f, to in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))])
