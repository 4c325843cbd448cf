"""One release of noisy public tables from a private table, and its document."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, histogram_bin
from hushtable.operators.counts import cell_rates, coerce, domain, long_bins
from hushtable.operators.ledger import Ledger, check_unit, divide, laplace


@dataclass(frozen=True)
class Release:
    """Public tables: cohorts (cohort, size, share of positives), marginals (cohort, positive, col, bin, share), cells (level, cell, support, rate)."""

    cohorts: pd.DataFrame
    marginals: pd.DataFrame
    cells: pd.DataFrame
    audit: dict
    notes: list[str]

    def to_json(self) -> str:
        tables = {k: getattr(self, k).to_dict("records") for k in ("cohorts", "marginals", "cells")}
        return json.dumps(tables | {"audit": self.audit, "notes": self.notes})

    @classmethod
    def from_json(cls, document: str) -> Release:
        d = json.loads(document)
        return cls(*(pd.DataFrame(d[k]) for k in ("cohorts", "marginals", "cells")), d["audit"], d["notes"])

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {k: spark.createDataFrame(getattr(self, k)) for k in ("cohorts", "marginals", "cells")}


def class_histogram(df: DataFrame, schema: Schema, cohorts: list[str]) -> DataFrame:
    """Counts of every bin of every column in each cohort and class, over the public domain; pooled counts are sums of these."""
    binned = lambda c: histogram_bin(F.col(c), schema.numeric[c]) if c in schema.numeric else F.col(c)
    keys = ["cohort", "positive", "col", "bin"]
    counts = long_bins(coerce(df, schema), schema, binned).groupBy(*keys).agg(F.sum("n").alias("n"))
    every = reduce(DataFrame.unionByName, (domain(df, cohort=cohorts, positive=[True, False], col=[c], bin=schema.bins(c)) for c in [*schema.numeric, *schema.categorical]))
    return every.join(counts, keys, "left").na.fill(0, ["n"])


def release(df: DataFrame, schema: Schema, cohorts: list[str], epsilon: float = 2.0, conditional_fraction: float = 0.2, n_min: int = 150, rows_per_person: int | None = None, acknowledged: bool = False, seed: int | None = None) -> Release:
    """Noisy cohort sizes, histograms by cohort and class, and conditional rates, within one budget.

    Cohorts and cells whose noisy size is under n_min are left out. Two Spark jobs count over the public domain; what comes
    to the driver is bounded by that domain, and noise is drawn there once.
    """
    if n_min < 50:
        raise ValueError("n_min must be at least 50")
    columns = [*schema.numeric, *schema.categorical]
    ledger, budget = Ledger(epsilon), divide(epsilon, conditional_fraction, len(columns))
    notes = [note for note in (check_unit(epsilon, rows_per_person, acknowledged), seed is not None and "seeded noise: no guarantee") if note]
    draws = iter(range(1 << 30))
    noise = lambda scale, n: laplace(scale, n, None if seed is None else hash((seed, next(draws))) & 0xFFFFFFFF)

    h = class_histogram(df, schema, cohorts).toPandas().sort_values(["cohort", "positive", "col", "bin"], ignore_index=True)
    sizes = coerce(df, schema).groupBy(F.col(schema.stratify).alias("cohort"), (F.col(schema.target) == schema.positive).alias("positive")).count()
    sizes = sizes.toPandas().pivot_table("count", "cohort", "positive", "sum").reindex(index=sorted(cohorts), columns=[False, True]).fillna(0)
    size = sizes.sum(axis=1) + noise(ledger.spend("sizes of cohorts", budget.cohorts, cohorts), len(sizes))
    kept = [c for c in sizes.index if size[c] >= n_min]
    if not kept:
        raise ValueError("no cohort has enough rows")
    balance = np.maximum(sizes.loc[kept] + noise(ledger.spend("marginals", budget.query, kept), 2 * len(kept)).reshape(-1, 2), 0)
    total = balance.sum(axis=1)
    positive = (balance[True] / total.where(total > 0)).fillna(0.5)
    table = pd.DataFrame({"cohort": kept, "size": [max(n_min, round(size[c])) for c in kept], "positive_share": positive.round(5).tolist()})

    h = h[h["cohort"].isin(kept)].reset_index(drop=True)
    for _ in columns:
        scale = ledger.spend("marginals", budget.query, [f"{c}/{p}" for c in kept for p in (0, 1)])
    h["noisy"] = np.maximum(h["n"] + noise(scale, len(h)), 0)
    block = h.groupby(["cohort", "positive", "col"])["noisy"]
    sums = block.transform("sum")
    h["share"] = (h["noisy"] / sums.where(sums > 0)).fillna(1 / block.transform("size")).round(5)

    cells = cell_rates(coerce(df, schema), schema).toPandas().sort_values(["level", "cell"], ignore_index=True)
    for level in range(len(schema.levels)):
        at = cells["level"] == level
        cells.loc[at, "noisy"] = cells.loc[at, "support"] + noise(ledger.spend(f"supports of level {level}", budget.cells / len(schema.levels)), at.sum())
    cells = cells[cells["noisy"] >= n_min].reset_index(drop=True) if schema.levels else cells.assign(noisy=0.0)
    viable = cells["level"].unique()
    for level in viable:
        at = cells["level"] == level
        hits = cells.loc[at, "positives"] + noise(ledger.spend(f"rates of level {level}", budget.rates / len(viable)), at.sum())
        cells.loc[at, "rate"] = np.clip(np.maximum(hits, 0) / np.maximum(cells.loc[at, "noisy"], n_min), 0, 1).round(5)
    if schema.levels and not len(cells):
        raise ValueError("no cell has enough rows")
    cells["level"], cells["support"] = cells["level"].astype("int64"), cells["noisy"].round().astype("int64")
    ledger.seal()
    if ledger.remaining > 0.02 * epsilon:
        notes.append("a part of the budget was not spent")
    return Release(table, h[["cohort", "positive", "col", "bin", "share"]], cells[["level", "cell", "support", "rate"]], ledger.audit(), notes)
