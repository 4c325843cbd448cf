"""The distribution of greatest entropy that agrees with a release, over the columns that its cells join."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

from hushtable.functions.bins import Schema
from hushtable.operators.stage import Release

#: The fitted array is held on the driver; a public domain with more entries is refused.
ENTRIES = 2_000_000


@dataclass(frozen=True)
class Joint:
    """Shares over (cohort, class, bins of each joined column), adding up to 1.

    `apart` is the mean total variation between the fitted and released shares of a cohort's columns: 0 where all agree.
    """

    cohorts: list[str]
    columns: list[str]
    shares: np.ndarray
    apart: float


def fit(release: Release, schema: Schema, rounds: int = 300, tolerance: float = 1e-7) -> Joint:
    """Iterative proportional fitting from independent columns, which ends at the greatest entropy where the release is consistent.

    Each round meets positives and negatives of every released cell, then the columns' shares in each cohort and class, then
    cohorts and classes themselves, so that the last hold exactly. Cells that were not released keep their share. Only public
    tables are read. A column that no cell names isn't joined: it is independent of the others given cohort and class.
    """
    cohorts = release.cohorts["cohort"].tolist()
    columns = [c for c in [*schema.numeric, *schema.categorical] if c != schema.stratify and any(c in level for level in schema.levels)]
    widths = [len(schema.bins(c)) for c in columns]
    if 2 * len(cohorts) * np.prod(widths, dtype=float) > ENTRIES:
        raise ValueError(f"the joined columns have {2 * len(cohorts) * np.prod(widths, dtype=float):.0f} entries; use wider bins or fewer columns in levels")
    size = release.cohorts["size"].to_numpy(float)
    share = release.cohorts["positive_share"].to_numpy(float)
    classes = (size / size.sum())[:, None] * np.stack([1 - share, share], axis=1)
    known = {k: dict(zip(part["bin"], part["share"])) for k, part in release.marginals.groupby(["cohort", "positive", "col"])}
    goals = []
    for axis, c in enumerate(columns, 2):
        table = np.array([[[known[a, p, c].get(b, 0.0) for b in schema.bins(c)] for p in (False, True)] for a in cohorts])
        goals.append(((0, 1, axis), classes[:, :, None] * table / table.sum(axis=2, keepdims=True)))
    cells = []
    for i, level in enumerate(schema.levels):
        axes = tuple(0 if c == schema.stratify else 2 + columns.index(c) for c in level)
        labels = [[f"{c}={a}" for a in cohorts] if c == schema.stratify else schema.cells(c) for c in level]
        place = {" & ".join(names) if names else "*": at for names, at in zip(product(*labels), product(*[range(len(x)) for x in labels]))}
        goal = np.full((2, *[len(x) for x in labels]), np.nan)
        for r in release.cells[release.cells["level"] == i].itertuples():
            if r.cell in place:
                goal[(slice(None), *place[r.cell])] = np.array([1 - r.rate, r.rate]) * r.support / size.sum()
        cells.append(((1, *axes), goal))
    p = np.ones((len(cohorts), 2, *widths)) * classes.reshape(*classes.shape, *[1] * len(widths))
    for axes, goal in goals:
        p = p * _shaped(np.maximum(goal, 1e-9) / np.maximum(classes, 1e-12)[:, :, None], axes, p.ndim)
    for _ in range(rounds):
        before = p
        for axes, goal in [*cells, *goals, ((0, 1), classes)]:
            p = _met(p, axes, goal)
        if np.abs(p - before).sum() < tolerance:
            break
    if not np.isfinite(p).all() or p.sum() <= 0:
        raise ValueError("the release can't be fitted: shares are missing or all 0")
    apart = [np.abs(_sums(p, axes) - goal).sum(axis=(1, 2)) / 2 / np.maximum(classes.sum(axis=1), 1e-12) for axes, goal in goals]
    return Joint(cohorts, columns, p, float(np.mean(apart)) if apart else 0.0)


def _sums(p: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    kept = sorted(axes)
    return p.sum(axis=tuple(k for k in range(p.ndim) if k not in axes)).transpose([kept.index(a) for a in axes])


def _shaped(table: np.ndarray, axes: tuple[int, ...], ndim: int) -> np.ndarray:
    """A table over some axes, ready to be multiplied into the whole array."""
    out = table.transpose(np.argsort(axes))
    return out.reshape([out.shape[sorted(axes).index(k)] if k in axes else 1 for k in range(ndim)])


def _met(p: np.ndarray, axes: tuple[int, ...], goal: np.ndarray) -> np.ndarray:
    have = _sums(p, axes)
    factor = np.where(np.isnan(goal) | (have <= 0), 1.0, goal / np.where(have > 0, have, 1.0))
    p = p * _shaped(factor, axes, p.ndim)
    return p / p.sum()
