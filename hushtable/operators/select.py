"""Choose rows of a pool so that their counts follow a release: raking over signatures, a systematic draw, exchanges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, number, selection_bin, text, undiscretise
from hushtable.operators.distances import pool_coverage
from hushtable.operators.ranks import ranked, unit_hash
from hushtable.operators.stage import Release

#: A pool must have so many times the rows that a cohort owes.
COVER = 1.1
#: Signatures come to the driver; a public domain that could have more is refused before anything is read.
SIGNATURES = 2_000_000


def with_signature(pool: DataFrame, schema: Schema) -> DataFrame:
    """Adds cohort, class and the bin of every column; numbers outside the edges fall in the boundary bins, texts outside the domain in none."""
    binned = lambda c: selection_bin(number(c), schema.numeric[c]).cast("string") if c in schema.numeric else F.when(text(c).isin(list(schema.categorical[c])), text(c))
    parts = [F.coalesce(binned(c), F.lit("")).alias(f"_bin_{c}") for c in [*schema.numeric, *schema.categorical]]
    return pool.select("*", F.coalesce(text(schema.stratify), F.lit("")).alias("_cohort"), F.coalesce(text(schema.target) == schema.positive, F.lit(False)).alias("_positive"), *parts)


def level_keys(signatures: pd.DataFrame, schema: Schema) -> list[list[tuple]]:
    """For each level, the (level, cell, class) of every signature; a missing number counts in the first bin, as in selection."""
    label = {c: dict(zip(schema.bins(c), schema.cells(c))) for c in [*schema.numeric, *schema.categorical]}
    out = []
    for i, level in enumerate(schema.levels):
        parts = [[label[c].get(b, "") for b in signatures[f"_bin_{c}"]] if c in label else [f"{c}={a}" for a in signatures["_cohort"]] for c in level]
        out.append([(i, " & ".join(x[at] for x in parts) or "*", p) for at, p in enumerate(signatures["_positive"].tolist())])
    return out


def cell_goals(release: Release, n: int) -> dict[tuple, float]:
    """Rows that n ones should have in each released cell and class: (level, cell, class) to a number."""
    part = n / release.cohorts["size"].sum()
    return {(int(r.level), r.cell, p): (r.rate if p else 1 - r.rate) * r.support * part for r in release.cells.itertuples() for p in (True, False)}


def inclusion_weights(signatures: pd.DataFrame, release: Release, columns: list[str], n: int, rounds: int = 40, least: float = 1.0, schema: Schema | None = None) -> np.ndarray:
    """The chance of each signature's rows to be chosen, from 0 to 1, fitted to the release in turns.

    Blocks are met in order: with a schema its levels' released cells by class, then cohort sizes, classes in cohorts, then
    each column's bins by cohort and class. Cells that weren't released bind nothing. Targets under
    `least` rows are left out; a signature with a value outside the public domain or in no released cohort has weight 0.
    """
    count = signatures["n"].to_numpy(float)
    size = release.cohorts.set_index("cohort")
    share = size["size"] / size["size"].sum() * n
    by_class = {(c, p): share[c] * (size.at[c, "positive_share"] if p else 1 - size.at[c, "positive_share"]) for c in size.index for p in (True, False)}
    marginal = {(r.cohort, bool(r.positive), r.col, r.bin): r.share * by_class[r.cohort, bool(r.positive)] for r in release.marginals.itertuples()}
    cohort, positive = signatures["_cohort"].tolist(), signatures["_positive"].tolist()
    blocks = [([share.get(c) for c in cohort], cohort), ([by_class.get(k) for k in zip(cohort, positive)], list(zip(cohort, positive)))]
    for c in columns:
        keys = [(a, p, c, b) for a, p, b in zip(cohort, positive, signatures[f"_bin_{c}"])]
        blocks.append(([marginal.get(k) for k in keys], keys))
    fit = []
    known = np.ones(len(count), bool)
    goals = cell_goals(release, n)
    for keys in level_keys(signatures, schema) if schema else []:
        targets = np.array([goals.get(k, np.nan) for k in keys], float)
        fit.append((np.where((targets > 0) & (targets < least), np.nan, targets), pd.factorize(pd.Index(keys, tupleize_cols=False))[0]))
    for targets, keys in blocks:
        known &= np.array([t is not None for t in targets], bool)
        fit.append((np.array([t if t is not None and not 0 < t < least else np.nan for t in targets], float), pd.factorize(pd.Index(keys, tupleize_cols=False))[0]))
    w = np.where(known, min(1.0, n / max(count.sum(), 1.0)), 0.0)
    for _ in range(rounds):
        for target, group in fit:
            have = np.bincount(group, w * count)[group]
            w *= np.where(np.isnan(target) | (have <= 0), 1.0, target / np.where(have > 0, have, 1.0))
        w = fill(np.clip(w, 0, 1), count, n)
    return w


def fill(w: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Scale weights until they add up to n with none over 1, as far as there are rows."""
    for _ in range(100):
        total, full = (w * count).sum(), (count * (w >= 1)).sum()
        if abs(total - n) < 1e-9 * n or total <= full:
            break
        w = np.where(w < 1, np.minimum(w * (n - full) / (total - full), 1), w) if total < n else w * n / total
    return w


def systematic(weight: np.ndarray, count: np.ndarray, n: int, start: float) -> np.ndarray:
    """How many rows of each signature an even step over the summed weights picks, beginning at `start` in [0, 1)."""
    ends = np.concatenate([[0.0], np.cumsum(weight * count)])
    if ends[-1] > n - 1e-6:
        ends = np.minimum(ends * (n / ends[-1]), n)
        ends[-1] = n
    return np.minimum(np.diff(np.floor(ends - start)).astype(int), count)


def swapped(signatures: pd.DataFrame, quota: np.ndarray, release: Release, schema: Schema, n: int, swaps: int, pooled: float = 3.0) -> np.ndarray:
    """Quotas after up to `swaps` exchanges, each of which brings the counts nearer to the release in summed absolute difference.

    Counted are cohorts, classes, each column's bins by cohort and class, positives and negatives of released cells, and each
    column's bins over all cohorts, a difference in which counts `pooled` times: what a user compares first. An
    exchange moves the same number of rows, from a thousandth of n down to one, out of the signature that has most to spare
    and into the one that then gains most; it stops where none gains. Signatures of no released cohort or value get no rows.
    """
    size = release.cohorts.set_index("cohort")
    total = size["size"].sum()
    cohort, positive = signatures["_cohort"].tolist(), signatures["_positive"].tolist()
    share = {(c, p): size.at[c, "size"] / total * n * (size.at[c, "positive_share"] if p else 1 - size.at[c, "positive_share"]) for c in size.index for p in (True, False)}
    goals = {("cohort", c): size.at[c, "size"] / total * n for c in size.index} | share
    goals |= {(r.cohort, bool(r.positive), r.col, r.bin): r.share * share[r.cohort, bool(r.positive)] for r in release.marginals.itertuples()}
    for r in release.marginals.itertuples():
        goals["pooled", r.col, r.bin] = goals.get(("pooled", r.col, r.bin), 0.0) + r.share * share[r.cohort, bool(r.positive)]
    goals |= cell_goals(release, n)
    keys = [[("cohort", c) for c in cohort], list(zip(cohort, positive))]
    for c in [*schema.numeric, *schema.categorical]:
        keys.append([(a, p, c, b) for a, p, b in zip(cohort, positive, signatures[f"_bin_{c}"])])
    usable = np.all([[k in goals for k in part] for part in keys], axis=0)
    keys += level_keys(signatures, schema)
    keys += [[("pooled", c, b) for b in signatures[f"_bin_{c}"]] for c in [*schema.numeric, *schema.categorical]]
    codes, names = pd.factorize(pd.Index([k for part in keys for k in part], tupleize_cols=False))
    at = codes.reshape(len(keys), -1)
    weight = np.array([(pooled if k[0] == "pooled" else 1.0) * (k in goals) for k in names], float)
    off = -np.array([goals.get(k, 0.0) for k in names])
    quota, count = quota.copy(), signatures["n"].to_numpy()
    for part in at:
        np.add.at(off, part, quota)
    change = lambda by: (weight * (np.abs(off) - np.abs(off + by)))[at].sum(axis=0)
    step = max(1, n // 1000)
    for _ in range(swaps):
        spare = np.where(quota >= step, change(-step), -np.inf)
        out = int(spare.argmax())
        off[at[:, out]] -= step
        wanted = np.where(usable & (count - quota >= step), change(step), -np.inf)
        into = int(wanted.argmax())
        if spare[out] + wanted[into] > 1e-9:
            off[at[:, into]] += step
            quota[out] -= step
            quota[into] += step
            continue
        off[at[:, out]] += step
        if step == 1:
            break
        step //= 2
    return quota


def select_to_release(pool: DataFrame, release: Release, schema: Schema, n: int, ids: list[str], seed: int = 0, allow_short: bool = False, swaps: int = 200, within_bins: bool = False) -> DataFrame:
    """n rows of the pool whose counts follow the release; `ids` tell rows apart. With `within_bins` their numbers are drawn
    anew in their bins, so that nothing finer than the release is taken from the pool.

    The pool is counted by signature, of which the public domain bounds the number; weights are fitted on these counts.
    The even draw is then bettered by up to `swaps` exchanges between signatures.
    Which rows of a signature are taken is decided by exact ranks in hash order, so no signature is sorted in one task.
    """
    columns = [*schema.numeric, *schema.categorical]
    bound = 2 * len(release.cohorts)
    for c in columns:
        bound *= len(schema.bins(c)) + 1
    if bound > SIGNATURES:
        raise ValueError(f"the public domain has up to {bound} signatures; use wider bins or fewer columns")
    sizes = pool.sparkSession.createDataFrame(release.cohorts[["cohort", "size"]])
    short = pool_coverage(pool, sizes, schema.stratify, n).where(F.col("ratio") < COVER)
    if not allow_short and not short.isEmpty():
        raise ValueError("the pool has too few rows of a cohort")
    keys = ["_cohort", "_positive", *(f"_bin_{c}" for c in columns)]
    rows = with_signature(pool, schema).where(F.col("_cohort").isin(release.cohorts["cohort"].tolist()))
    signatures = rows.groupBy(*keys).agg(F.count("*").alias("n")).toPandas().sort_values(keys, ignore_index=True)
    if signatures["n"].sum() < n:
        raise ValueError(f"the pool has fewer than {n} rows in released cohorts")
    weight = inclusion_weights(signatures, release, columns, n, schema=schema)
    drawn = systematic(weight, signatures["n"].to_numpy(), n, np.random.default_rng(seed).random())
    signatures["_quota"] = swapped(signatures, drawn, release, schema, n, swaps)
    quotas = pool.sparkSession.createDataFrame(signatures.loc[signatures["_quota"] > 0, [*keys, "_quota"]])
    wanted = rows.join(F.broadcast(quotas), keys)
    chosen = ranked(wanted, keys, ids, seed).where(F.col("rank") < F.col("_quota")).select(*pool.columns)
    return redraw(chosen, schema, ids, seed) if within_bins else chosen


def redraw(df: DataFrame, schema: Schema, ids: list[str], seed: int = 0, bands: dict[str, list[float]] | None = None) -> DataFrame:
    """Each number drawn anew within its bin, and within its cohort's band where `bands` names the column's band edges.

    Values outside the edges are drawn in the boundary bins; missing ones stay as they are. Whole edges give whole numbers, of
    which only the last bin holds its upper edge. The draw depends on `ids`, column and seed alone.
    """
    changed = {}
    for c, edges in schema.numeric.items():
        inner = [float(b) for b in (bands or {}).get(c, []) if edges[0] < b < edges[-1]]
        finer = sorted({*map(float, edges), *inner})
        u = unit_hash(F.concat_ws("|", *[F.col(k).cast("string") for k in ids], F.lit(c), F.lit(str(seed))))
        drawn = undiscretise(selection_bin(number(c), finer), finer, u, all(e.is_integer() for e in finer))
        changed[c] = F.when(number(c).isNotNull(), drawn)
    return df.withColumns(changed)
