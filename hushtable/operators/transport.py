"""Exact transport distance between two tables over sets of columns, each set solved in a task of its own."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, clipped, text
from hushtable.operators.ranks import sample_exactly


def least_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving whole supplies to whole demands with the same sum.

    Shortest augmenting paths under prices that keep all reduced costs from falling below 0: each source in turn reaches the
    nearest sink that still wants something, over sinks whose own sources could turn to others. Each path uses up a
    source, fills a sink or empties a flow.
    """
    supply, demand = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    if supply.sum() != demand.sum():
        raise ValueError("supplies and demands must have the same sum")
    u, v = cost.min(axis=1) if cost.size else np.zeros(len(supply)), np.zeros(len(demand))
    flows: list[dict[int, int]] = [{} for _ in demand]
    for i in range(len(supply)):
        while supply[i]:
            far, by = cost[i] - u[i] - v, np.full(len(demand), i)
            open_, reached, over = np.ones(len(demand), bool), {i: 0.0}, {}
            while True:
                j = int(np.where(open_, far, np.inf).argmin())
                if demand[j]:
                    break
                open_[j] = False
                for s in flows[j]:
                    if s not in reached:
                        reached[s], over[s] = far[j], j
                        new = far[j] + cost[s] - u[s] - v
                        better = open_ & (new < far)
                        far[better], by[better] = new[better], s
            path, s, amount = [], int(by[j]), min(supply[i], demand[j])
            path.append((s, j))
            while s != i:
                back = over[s]
                amount = min(amount, flows[back][s])
                path.append((s, back))
                s = int(by[back])
                path.append((s, back))
            for s, d in reached.items():
                u[s] += far[j] - d
            done = ~open_
            v[done] -= far[j] - far[done]
            for step, (s, t) in enumerate(path):
                flows[t][s] = flows[t].get(s, 0) + (amount if step % 2 == 0 else -amount)
                if not flows[t][s]:
                    del flows[t][s]
            supply[i] -= amount
            demand[j] -= amount
    return float(sum(f * cost[s, t] for t, flow in enumerate(flows) for s, f in flow.items()))


def distance(a: pd.DataFrame, b: pd.DataFrame, numbers: int) -> float:
    """Between points (columns but the last, numbers first) with counts (the last): Euclidean over numbers and one-hot values."""
    x, y = a.to_numpy(), b.to_numpy()
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1] - 1):
        d += (x[:, k, None].astype(float) - y[None, :, k].astype(float)) ** 2 if k < numbers else 2.0 * (x[:, k, None] != y[None, :, k])
    n, m = x[:, -1].astype(np.int64), y[:, -1].astype(np.int64)
    common = np.gcd(n.sum(), m.sum())
    left, right = n * (m.sum() // common), m * (n.sum() // common)
    return least_cost(left, right, np.sqrt(d)) / float(left.sum())


def k_way_transport(real: DataFrame, other: DataFrame, schema: Schema, k: int, ids: list[str], most: int = 2000, seed: int = 0) -> DataFrame:
    """Wasserstein-1 distance of every set of k columns, the target among them, and their mean: (col, distance).

    Numbers are scaled to [0, 1] by their bounds (a missing one at the lowest), a missing text is `nan`. Of a table with
    more than `most` rows, `most` are drawn by hash: the exact problem grows with the cube of different points, and this
    bound is the operator's. A set is null where a table has no row.
    """
    names = [*schema.numeric, *schema.categorical, schema.target]
    if not 1 <= k <= len(names):
        raise ValueError(f"k must be from 1 to {len(names)}")
    scaled = {c: (F.coalesce(clipped(c, e), F.lit(float(e[0]))) - float(e[0])) / (float(e[-1]) - float(e[0])) for c, e in schema.numeric.items()}
    value = {c: scaled[c].cast("string") if c in scaled else F.coalesce(text(c), F.lit("nan")) for c in names}
    sets = list(combinations(names, k))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[value[c] for c in s]).alias("point")) for i, s in enumerate(sets)])
    side = lambda df, mine: sample_exactly(df, most, ids, seed).select(F.explode(parts).alias("p")).select("p.*", F.lit(mine).alias("mine"))
    points = side(real, True).unionByName(side(other, False)).groupBy("i", "point").agg(F.count_if("mine").alias("a"), F.count_if(~F.col("mine")).alias("b"))
    label = ["|".join(s) for s in sets]
    numbers = [sum(c in schema.numeric for c in s) for s in sets]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        i = int(frame["i"].iloc[0])
        frame = frame.assign(_key=frame["point"].map(tuple)).sort_values("_key")
        table = pd.DataFrame(frame["point"].tolist())
        sides = [table.assign(n=frame[c].to_numpy())[frame[c].to_numpy() > 0] for c in ("a", "b")]
        return pd.DataFrame({"col": [label[i]], "distance": [distance(*sides, numbers[i]) if len(sides[0]) and len(sides[1]) else None]})

    found = points.repartition(len(sets), "i").groupBy("i").applyInPandas(solve, "col string, distance double")
    named = F.explode(F.array(F.col("col"), F.lit("mean"))).alias("col")
    return found.select(named, "distance").groupBy("col").agg(F.round(F.avg("distance"), 9).alias("distance"))
