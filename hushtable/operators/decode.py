"""Rows from a release alone: no private row is read, so decoding costs no budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, undiscretise
from hushtable.operators.fitted import CLASS, COHORT, domains, fit_release
from hushtable.operators.graphical import Model, sampled
from hushtable.operators.joint import Joint
from hushtable.operators.select import select_to_release, systematic
from hushtable.operators.stage import Release

#: Drawn rows of one cell are written in runs of at most so many, so that a hot cell is shared out.
RUN = 10_000


def unit(name: str, seed: int, row: str = "row") -> Column:
    """A number in [0, 1) for each row and name: a hash, so that a task that is run again draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(row)), F.lit(1 << 52)) / float(1 << 52)


def quotas(release: Release, n: int) -> list[tuple[str, bool, int]]:
    """How many rows each cohort and class gets: largest remainders over cohorts, then over the two classes."""
    exact = release.cohorts["size"].to_numpy(float) / release.cohorts["size"].sum() * n
    rows = np.floor(exact).astype(int)
    rows[np.argsort(rows - exact, kind="stable")[: n - rows.sum()]] += 1
    out = []
    for cohort, share, k in zip(release.cohorts["cohort"], release.cohorts["positive_share"], rows):
        positives = int(round(share * k))
        out += [(cohort, True, positives), (cohort, False, int(k) - positives)]
    return out


def below(sums: Column, u: Column) -> Column:
    return F.size(F.filter(sums, lambda x: x <= u))


def spread(spark: SparkSession, fitted: Joint, blocks: list[tuple[str, bool, int]], n: int, seed: int) -> DataFrame:
    """Rows (row, block, a place `_at_` of each joined column): an even step over each block's fitted cells says how many.

    The driver lists runs of at most RUN rows, as many as cells with rows and n / RUN; tasks write them out.
    """
    start = np.random.default_rng(seed).random()
    shape = fitted.shares.shape[2:]
    runs, first = [], 0
    for i, (cohort, positive, rows) in enumerate(blocks):
        weight = fitted.shares[fitted.cohorts.index(cohort), int(positive)].ravel()
        counts = systematic(weight / weight.sum(), np.full(len(weight), rows), rows, start)
        for cell in np.flatnonzero(counts):
            at = [int(x) for x in np.unravel_index(cell, shape)] if shape else []
            for begin in range(0, int(counts[cell]), RUN):
                k = min(RUN, int(counts[cell]) - begin)
                runs.append((i, at, first, first + k - 1))
                first += k
    table = spark.createDataFrame(runs, "block int, _at array<int>, _first long, _last long").repartition(max(1, -(-n // 500_000)), "_first")
    places = [F.col("_at")[k].alias(f"_at_{c}") for k, c in enumerate(fitted.columns)]
    return table.select("block", *places, F.explode(F.sequence("_first", "_last")).alias("row"))


def draw(spark: SparkSession, release: Release, schema: Schema, n: int, seed: int = 0, fitted: Joint | Model | None = None) -> DataFrame:
    """n rows (row, features, target): columns of a fitted distribution are drawn together, all others are independent
    given cohort and class.

    A column outside it is drawn by inverting its released distribution; a numeric value lies evenly in its bin, and is whole
    where all edges are. Sizes of cohorts and classes are exact.
    """
    blocks = [b for b in quotas(release, n) if b[2]]
    starts = np.concatenate([[0], np.cumsum([b[2] for b in blocks])])[:-1].tolist()
    shares = {k: dict(zip(part["bin"], part["share"])) for k, part in release.marginals.groupby(["cohort", "positive", "col"])}
    columns = [*schema.numeric, *schema.categorical]
    table = []
    for i, (cohort, positive, _) in enumerate(blocks):
        cdfs = [np.cumsum([shares[cohort, positive, c].get(b, 0.0) for b in schema.bins(c)]) for c in columns]
        table.append((i, cohort, positive, [(x / x[-1]).tolist() for x in cdfs]))
    known = spark.createDataFrame(table, "block int, _cohort string, _positive boolean, _cdf array<array<double>>")
    if not isinstance(fitted, Joint):
        begins = F.array(*[F.lit(s) for s in starts])
        rows = spark.range(n).withColumnRenamed("id", "row").withColumn("block", F.size(F.filter(begins, lambda s: s <= F.col("row"))) - 1)
    else:
        rows = spread(spark, fitted, blocks, n, seed)
    joined = [] if fitted is None else fitted.columns if isinstance(fitted, Joint) else list(domains(release, schema))[2:]
    if isinstance(fitted, Model):
        places = {c: i for i, c in enumerate(release.cohorts["cohort"])}
        for name, at in ((COHORT, [places[b[0]] for b in blocks]), (CLASS, [int(b[1]) for b in blocks])):
            rows = rows.withColumn(f"_at_{name}", F.element_at(F.array(*[F.lit(x) for x in at]), F.col("block") + 1))
        rows = sampled(rows, fitted, (COHORT, CLASS), seed)
    rows = rows.join(F.broadcast(known), "block")
    out = []
    for k, c in enumerate(columns):
        if c in joined:
            at = F.col(f"_at_{c}")
        else:
            at = F.least(below(F.col("_cdf")[k], unit(c, seed)), F.lit(len(schema.bins(c)) - 1))
        if c in schema.numeric:
            edges = schema.numeric[c]
            value = undiscretise(at, edges, unit(f"{c} in its bin", seed), all(float(e).is_integer() for e in edges))
        else:
            value = F.element_at(F.array(*[F.lit(v) for v in schema.categorical[c]]), at + 1)
        out.append((F.col("_cohort") if c == schema.stratify else value).alias(c))
    if schema.stratify not in columns:
        out.append(F.col("_cohort").alias(schema.stratify))
    label = F.when(F.col("_positive"), F.lit(schema.positive)).otherwise(F.lit(schema.negative))
    return rows.select("row", *out, label.alias(schema.target))


def decode(spark: SparkSession, release: Release, schema: Schema, n: int, pool_factor: int = 3, seed: int = 0, joint: bool = True) -> DataFrame:
    """n rows selected to the release from a drawn pool of pool_factor times as many.

    With `joint`, the pool follows the distribution of greatest entropy fitted along a junction tree, so that cells of the
    release are met too, however many columns they join.
    """
    fitted = fit_release(release, schema) if joint and len(release.cells) else None
    return select_to_release(draw(spark, release, schema, n * pool_factor, seed, fitted), release, schema, n, ["row"], seed)
