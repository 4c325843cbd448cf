"""Private releases that choose which tables to measure: a spanning tree of pairs, and rounds of the worst met table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, histogram_bin, undiscretise
from hushtable.operators.counts import coerce
from hushtable.operators.graphical import fit, junction_tree, Measured, Model, sampled
from hushtable.operators.ledger import exponential_choice, gaussian, Ledger, rho_of

#: Shares of the budget for measuring and for choosing, and rounds for each column, unless stated.
MEASURE, CHOOSE, ROUNDS = 0.9, 0.1, 16


@dataclass(frozen=True)
class Chosen:
    """A model, the sets of columns that were measured for it in turn, and the audit (amounts are rho)."""

    model: Model
    sets: list[tuple[str, ...]]
    audit: dict


def table_counts(df: DataFrame, schema: Schema, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], np.ndarray]:
    """Exact counts over the bins of each set of columns, from one job.

    Rows are first counted by the bins of all columns, then each such signature is dealt to the sets. Values outside the
    public domain are in no table that has their column. What comes to the driver is bounded by the sets' domains.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    places = lambda c: reduce(lambda out, x: F.when(F.col(c) == x[1], x[0]).otherwise(out), enumerate(schema.bins(c)), F.lit(None).cast("int"))
    binned = [(histogram_bin(F.col(c), schema.numeric[c]) if c in schema.numeric else places(c)).alias(f"_{i}") for i, c in enumerate(columns)]
    signatures = coerce(df, schema).select(*binned).groupBy(*[f"_{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"))
    widths = {c: len(schema.bins(c)) for c in columns}
    cells = []
    for k, names in enumerate(sets):
        at = F.lit(0).cast("long")
        for c in names:
            at = at * widths[c] + F.col(f"_{columns.index(c)}")
        cells.append(F.struct(F.lit(k).alias("set"), at.alias("at")))
    counted = signatures.select(F.explode(F.array(*cells)).alias("cell"), "n").where("cell.at is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counted.select("cell.set", "cell.at", "n").toPandas()
    out = {}
    for k, names in enumerate(sets):
        table = np.zeros([widths[c] for c in names])
        own = found[found["set"] == k]
        table.reshape(-1)[own["at"].to_numpy(int)] = own["n"].to_numpy(float)
        out[names] = table
    return out


class Measurer:
    """Measures tables with Gaussian noise and chooses among them, each charged to one ledger of rho."""

    def __init__(self, counts: dict, rho: float, seed: int | None):
        self.counts, self.ledger, self.measured, self.sets = counts, Ledger(rho), [], []
        self.draws = iter(range(1 << 30))
        self.seed = lambda: None if seed is None else hash((seed, next(self.draws))) & 0xFFFFFFFF

    def measure(self, names: tuple[str, ...], rho: float) -> None:
        """One row changes one count by one, so a table's sensitivity is 1."""
        self.ledger.spend("measured", rho)
        table = self.counts[names]
        self.measured.append(Measured(names, table + gaussian(rho, 1.0, table.size, self.seed()).reshape(table.shape), 1 / np.sqrt(2 * rho)))
        self.sets.append(names)

    def choose(self, scores: np.ndarray, rho: float, sensitivity: float) -> int:
        """The exponential mechanism with epsilon spends epsilon squared over 8."""
        self.ledger.spend("chosen", rho)
        return exponential_choice(scores, np.sqrt(8 * rho), sensitivity, self.seed())

    def total(self) -> float:
        """The number of rows as the measured tables tell it, each weighted by the variance of its sum."""
        weight = np.array([1 / (m.counts.size * m.noise**2) for m in self.measured])
        return max(1.0, float(weight @ [m.counts.sum() for m in self.measured] / weight.sum()))

    def fitted(self, widths: dict[str, int], rounds: int) -> Model:
        return fit(widths, self.measured, self.total(), rounds=rounds, tolerance=1e-6)


def features(schema: Schema) -> list[str]:
    return list(dict.fromkeys([*schema.numeric, *schema.categorical, schema.target]))


def spanning_tree(df: DataFrame, schema: Schema, epsilon: float, delta: float = 1e-9, seed: int | None = None, rounds: int = 2000) -> Chosen:
    """Every column by itself, then pairs that make a tree: of those between parts not joined yet, likely the one that
    independent columns miss by most.

    A third of the budget each goes to single columns, to the choice of pairs and to the pairs.
    """
    names = features(schema)
    widths = {c: len(schema.bins(c)) for c in names}
    pairs = list(combinations(names, 2))
    own = Measurer(table_counts(df, schema, [*[(c,) for c in names], *pairs]), rho_of(epsilon, delta), seed)
    third = own.ledger.declared / 3
    for c in names:
        own.measure((c,), third / len(names))
    alone = own.fitted(widths, rounds)
    missed = {p: np.abs(own.counts[p] - alone.total * alone.table(p)).sum() for p in pairs}
    part = {c: k for k, c in enumerate(names)}
    tree = []
    while len(set(part.values())) > 1:
        open_ = [p for p in pairs if part[p[0]] != part[p[1]]]
        a, b = open_[own.choose(np.array([missed[p] for p in open_]), third / (len(names) - 1), 1.0)]
        tree.append((a, b))
        part = {c: part[a] if k == part[b] else k for c, k in part.items()}
    for p in tree:
        own.measure(p, third / len(tree))
    own.ledger.seal()
    return Chosen(own.fitted(widths, rounds), own.sets, own.ledger.audit())


def worst_tables(df: DataFrame, schema: Schema, epsilon: float, delta: float = 1e-9, workload: dict[tuple[str, ...], float] | None = None, rounds: int | None = None, entries: int = 1_000_000, seed: int | None = None, fit_rounds: int = 1000) -> Chosen:
    """Rounds that each measure the table which the model so far misses by most, beyond what noise alone would show.

    Candidates are all subsets of the workload's sets (all pairs, if none is given); one counts as much as it overlaps with
    the workload. A candidate must keep the bags of the model within its share of `entries`, which grows with the budget
    used. When measuring a table changed the model by less than its noise, noise is halved from then on. The last
    round uses what is left, so that the whole budget is spent.
    """
    names = features(schema)
    widths = {c: len(schema.bins(c)) for c in names}
    workload = workload or {p: 1.0 for p in combinations(names, 2)}
    candidates = sorted({s for w in workload for k in range(1, len(w) + 1) for s in combinations(sorted(w, key=names.index), k)}, key=lambda s: (len(s), [names.index(c) for c in s]))
    weight = np.array([sum(x * len(set(s) & set(w)) for w, x in workload.items()) for s in candidates])
    own = Measurer(table_counts(df, schema, list(dict.fromkeys([*[(c,) for c in names], *candidates]))), rho_of(epsilon, delta), seed)
    ledger = own.ledger
    rounds = rounds or ROUNDS * len(names)
    measure, choose = MEASURE * ledger.declared / (rounds + len(names)), CHOOSE * ledger.declared / rounds
    for c in names:
        own.measure((c,), measure)
    model = own.fitted(widths, fit_rounds)
    while ledger.remaining > 1e-12 * ledger.declared:
        if ledger.remaining < 2 * (measure + choose):
            measure, choose = MEASURE * ledger.remaining, CHOOSE * ledger.remaining
        used = (ledger.total + measure + choose) / ledger.declared
        fits = [i for i, s in enumerate(candidates) if len(s) == 1 or _within(widths, own.sets, s, max(used * entries, sum(widths.values())))]
        noise = 1 / np.sqrt(2 * measure)
        miss = [weight[i] * (np.abs(own.counts[candidates[i]] - model.total * model.table(candidates[i])).sum() - np.sqrt(2 / np.pi) * noise * own.counts[candidates[i]].size) for i in fits]
        picked = candidates[fits[own.choose(np.array(miss), choose, float(np.max(weight[fits])))]]
        before = model.total * model.table(picked)
        own.measure(picked, measure)
        model = own.fitted(widths, fit_rounds)
        if np.abs(model.total * model.table(picked) - before).sum() <= np.sqrt(2 / np.pi) * noise * before.size:
            measure, choose = 4 * measure, 4 * choose
    ledger.seal()
    return Chosen(model, own.sets, ledger.audit())


def _within(widths: dict[str, int], sets: list, more: tuple[str, ...], entries: float) -> bool:
    try:
        junction_tree(widths, [*sets, more], entries=entries)
    except ValueError:
        return False
    return True


def drawn_rows(spark: SparkSession, model: Model, schema: Schema, n: int, seed: int = 0) -> DataFrame:
    """n rows (row, features) drawn from a model; a numeric value lies evenly in its bin, and is whole where all edges are."""
    rows = sampled(spark.range(n).withColumnRenamed("id", "row"), model, (), seed)
    out = []
    for c in features(schema):
        if c in schema.numeric:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(f"{c} in its bin"), F.col("row")), F.lit(1 << 52)) / float(1 << 52)
            out.append(undiscretise(F.col(f"_at_{c}"), schema.numeric[c], u, all(float(e).is_integer() for e in schema.numeric[c])).alias(c))
        else:
            out.append(F.element_at(F.array(*[F.lit(v) for v in schema.bins(c)]), F.col(f"_at_{c}") + 1).alias(c))
    return rows.select("row", *out)
