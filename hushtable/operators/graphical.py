"""A distribution of greatest entropy over many columns, from noisy tables over a few columns each.

Columns are eliminated one after the other; each one's bag holds it and the columns that it meets then, and the bags form a
junction tree. No array over all columns is ever made: the largest is the largest bag.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of all bags together; they are held on the driver and sent to tasks that draw rows.
ENTRIES = 20_000_000


@dataclass(frozen=True)
class Measured:
    """Counts over some columns' bins (nan: not measured), and the standard deviation of their noise (0: exact)."""

    columns: tuple[str, ...]
    counts: np.ndarray
    noise: np.ndarray | float = 0.0


@dataclass(frozen=True)
class Tree:
    """An order of elimination; the bag of a column is it and `above[column]`, in that order."""

    widths: dict[str, int]
    order: list[str]
    above: dict[str, tuple[str, ...]]

    def bag(self, column: str) -> tuple[str, ...]:
        return (column, *self.above[column])

    def home(self, columns) -> str:
        """The column whose bag holds a measured set: the one of them that is eliminated first."""
        return min(columns, key=self.order.index)


def junction_tree(widths: dict[str, int], cliques: list[tuple[str, ...]], last: tuple[str, ...] = (), entries: int = ENTRIES) -> Tree:
    """Eliminate, of the columns left, the one with the smallest bag (ties: the fewest new neighbours, then as listed).

    Columns in `last` go when no other is left, so that the rest can be drawn given them. Refused if the bags get too large.
    """
    near = {c: set() for c in widths}
    for clique in cliques:
        for c in clique:
            near[c] |= set(clique) - {c}
    for c in last:
        near[c] |= set(last) - {c}
    order, met = [], {}
    while near:
        free = [c for c in near if c not in last] or list(near)
        size = lambda c: widths[c] * np.prod([widths[x] for x in near[c]], dtype=float)
        new = lambda c: sum(b not in near[a] for a in near[c] for b in near[c] if a < b)
        c = min(free, key=lambda c: (size(c), new(c)))
        order.append(c)
        met[c] = near.pop(c)
        for a in met[c]:
            near[a] = (near[a] | met[c]) - {a, c}
    total = sum(widths[c] * np.prod([widths[x] for x in met[c]], dtype=float) for c in order)
    if total > entries:
        raise ValueError(f"the tables join columns in bags of {total:.0f} entries; use wider bins or fewer columns in levels")
    return Tree(dict(widths), order, {c: tuple(sorted(met[c], key=order.index)) for c in order})


def _spread(table: np.ndarray, have: tuple, want: tuple) -> np.ndarray:
    """A table over columns in the tree's order, ready to be combined with one over more of them."""
    sizes = dict(zip(have, table.shape))
    return table.reshape([sizes.get(c, 1) for c in want])


def _summed(table: np.ndarray, have: tuple, want: tuple) -> np.ndarray:
    return table.sum(axis=tuple(i for i, c in enumerate(have) if c not in want))


def calibrated(tree: Tree, potentials: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The logarithm of the sum over everything, each column's distribution given `above`, and the shares of each bag.

    One pass in the order of elimination sends to the next bag what summing a column out leaves; one against it multiplies
    the shares of what lies above with the distributions found.
    """
    bags = {c: np.zeros([tree.widths[x] for x in tree.bag(c)]) + potentials.get(c, 0.0) for c in tree.order}
    given, log_sum = {}, 0.0
    for c in tree.order:
        top = bags[c].max(axis=0)
        out = top + np.log(np.exp(bags[c] - top).sum(axis=0))
        given[c] = np.exp(bags[c] - out)
        if tree.above[c]:
            home = tree.above[c][0]
            bags[home] += _spread(out, tree.above[c], tree.bag(home))
        else:
            log_sum += float(out)
    shares = {}
    for c in reversed(tree.order):
        if tree.above[c]:
            home = tree.above[c][0]
            shares[c] = given[c] * _summed(shares[home], tree.bag(home), tree.above[c])
        else:
            shares[c] = given[c]
    return log_sum, given, shares


@dataclass(frozen=True)
class Model:
    """A fitted tree. `rounds` and `gap` say how the fit ended: the largest difference of shares that was left to mend."""

    tree: Tree
    total: float
    given: dict[str, np.ndarray]
    shares: dict[str, np.ndarray]
    rounds: int
    gap: float
    notes: list[str] = field(default_factory=list)

    def table(self, columns: tuple[str, ...], entries: int = ENTRIES) -> np.ndarray:
        """Shares over any columns: those that aren't asked for are summed out one at a time, where they matter at all."""
        tree, asked = self.tree, sorted(columns, key=self.tree.order.index)
        home = tree.home(columns) if columns else None
        if home and set(asked) <= set(tree.bag(home)):
            out = _summed(self.shares[home], tree.bag(home), tuple(asked))
        else:
            needed = set(asked)
            for c in tree.order:
                if c in needed:
                    needed |= set(tree.above[c])
            tables = [(tree.bag(c), self.given[c]) for c in tree.order if c in needed]
            for c in tree.order:
                if c in needed and c not in asked:
                    touched = [t for t in tables if c in t[0]]
                    have, product = _product(tree, touched, entries)
                    tables = [t for t in tables if c not in t[0]] + [(tuple(x for x in have if x != c), product.sum(axis=have.index(c)))]
            out = _product(tree, tables, entries)[1]
        return out.transpose([asked.index(c) for c in columns])


def _product(tree: Tree, tables: list, entries: int) -> tuple[tuple, np.ndarray]:
    have = tuple(sorted({c for names, _ in tables for c in names}, key=tree.order.index))
    if np.prod([tree.widths[c] for c in have], dtype=float) > entries:
        raise ValueError(f"the columns {', '.join(have)} have too many entries together")
    out = np.ones([1] * len(have))
    for names, table in tables:
        order = sorted(names, key=tree.order.index)
        out = out * _spread(table.transpose([names.index(c) for c in order]), tuple(order), have)
    return have, out


def fit(widths: dict[str, int], measured: list[Measured], total: float, last: tuple[str, ...] = (), slack: float = 0.01, rounds: int = 3000, tolerance: float = 1e-7) -> Model:
    """The distribution of greatest entropy whose counts agree with what was measured, within the noise.

    Each measured count has a multiplier t; the fit minimises log Z(t) - t * y / total + slack * noise^2 * t^2 / (2 * total),
    which is convex and, where noise isn't 0, has one end: counts y - slack * noise^2 * t. So counts that contradict each
    other part in proportion to their variance, and with consistent ones the entropy is the greatest, as slack goes to 0.
    Solved by a limited-memory quasi-Newton descent; `gap` in the result is the largest slope left.
    """
    tree = junction_tree(widths, [m.columns for m in measured], last)
    plans, y, noise = [], [], []
    for m in measured:
        asked = tuple(sorted(m.columns, key=tree.order.index))
        turn = [m.columns.index(c) for c in asked]
        goal = np.asarray(m.counts, float).transpose(turn)
        known = np.isfinite(goal)
        plans.append((tree.home(m.columns) if m.columns else tree.order[-1], asked, known))
        y.append(goal[known] / total)
        noise.append(np.broadcast_to(m.noise, np.shape(m.counts)).transpose(turn)[known])
    ends = np.cumsum([len(x) for x in y])
    y, penalty = np.concatenate(y), slack * np.concatenate(noise) ** 2 / total

    def at(t):
        potentials: dict[str, np.ndarray] = {}
        for (home, asked, known), part in zip(plans, np.split(t, ends[:-1])):
            table = np.zeros(known.shape)
            table[known] = part
            potentials[home] = potentials.get(home, 0.0) + _spread(table, asked, tree.bag(home))
        log_sum, given, shares = calibrated(tree, potentials)
        have = np.concatenate([_summed(shares[home], tree.bag(home), asked)[known] for home, asked, known in plans])
        return log_sum - t @ y + penalty @ (t * t) / 2, have - y + penalty * t, 1 / (np.maximum(have, 1e-9) + penalty), given, shares

    t, used, gap, given, shares = descend(at, np.zeros(len(y)), rounds, tolerance)
    notes = [] if gap <= tolerance else [f"the fit ended after {used} rounds with a slope of {gap:.2g}"]
    return Model(tree, total, given, shares, used, gap, notes)


def descend(at, t: np.ndarray, rounds: int, tolerance: float, memory: int = 100):
    """Limited-memory BFGS with halved steps; `at` gives (value, slope, inverse of the curvature's diagonal, *rest)."""
    value, slope, scale, *rest = at(t)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for done in range(rounds):
        gap = float(np.abs(slope).max(initial=0.0))
        if gap <= tolerance:
            return t, done, gap, *rest
        way, kept = slope.copy(), []
        for s, d in reversed(steps):
            a = (s @ way) / (s @ d)
            way -= a * d
            kept.append(a)
        if steps:
            s, d = steps[-1]
            way *= scale * (s @ d) / (d @ (scale * d))
        else:
            way *= scale
        for (s, d), a in zip(steps, reversed(kept)):
            way += (a - (d @ way) / (s @ d)) * s
        fall, step = slope @ way, 1.0
        if fall <= 0:
            way, fall, steps = scale * slope, slope @ (scale * slope), []
        while True:
            new = t - step * way
            new_value, new_slope, new_scale, *new_rest = at(new)
            if new_value <= value - 1e-4 * step * fall + 1e-15 * abs(value) or step < 1e-10:
                break
            step /= 2
        s, d = new - t, new_slope - slope
        if s @ d > 1e-14 * np.sqrt((s @ s) * (d @ d)):
            steps = [*steps, (s, d)][-memory:]
        stuck = step < 1e-10
        t, value, slope, scale, rest = new, new_value, new_slope, new_scale, new_rest
        if stuck:
            break
    return t, rounds, float(np.abs(slope).max(initial=0.0)), *rest


def sampled(rows: DataFrame, model: Model, given: tuple[str, ...], seed: int, prefix: str = "_at_", row: str = "row") -> DataFrame:
    """Rows with a place `_at_<column>` for every column: against the order of elimination, each from its distribution given
    the columns above it. The columns `given` have their place already and must be those eliminated last.

    Chances are hashes of seed, column and row, so a task that is run again draws the same. Tables go to the tasks once.
    """
    tree = model.tree
    drawn = [c for c in reversed(tree.order) if c not in given]
    if set(tree.order[len(drawn) :]) != set(given):
        raise ValueError("the given columns must be eliminated last")
    tables = {c: np.cumsum(model.given[c], axis=0).reshape(tree.widths[c], -1).T for c in drawn}
    above, widths = tree.above, tree.widths
    chance = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(f"drawn {c}"), F.col(row)), F.lit(1 << 52)) / float(1 << 52)).alias(f"_chance_{i}") for i, c in enumerate(drawn)]
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"{prefix}{c}", T.IntegerType()) for c in drawn]])

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            at = {c: batch.column(f"{prefix}{c}").to_numpy(zero_copy_only=False) for c in given}
            for i, c in enumerate(drawn):
                line = np.zeros(batch.num_rows, np.int64)
                for x in above[c]:
                    line = line * widths[x] + at[x]
                u = batch.column(f"_chance_{i}").to_numpy(zero_copy_only=False)
                at[c] = np.minimum((tables[c][line] <= u[:, None]).sum(axis=1), widths[c] - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *[pa.array(at[c], pa.int32()) for c in drawn]], names=schema.names)

    return rows.select("*", *chance).mapInArrow(draw, schema)
