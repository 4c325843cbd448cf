"""A release as noisy tables over a few columns each, and the distribution that is fitted to them."""

from __future__ import annotations

from itertools import product

import numpy as np

from hushtable.functions.bins import Schema
from hushtable.operators.graphical import Measured, Model, fit
from hushtable.operators.stage import Release

COHORT, CLASS = "_cohort", "_class"


def query_budgets(audit: dict) -> dict[str, float]:
    """What one query of each group cost: each entry of a ledger is one query on one part."""
    out: dict[str, float] = {}
    for e in audit["entries"]:
        out[e["group"]] = min(out.get(e["group"], np.inf), e["epsilon"])
    return out


def noise_of(audit: dict, group: str) -> float:
    """The standard deviation of a count of a group. A group that the audit doesn't list is taken to have had an even share
    of the declared budget with those that it does."""
    found = query_budgets(audit)
    return np.sqrt(2) / found.get(group, audit["declared"] / (len(found) + 1))


def domains(release: Release, schema: Schema) -> dict[str, list[str]]:
    """Cohort, class and every other column with its labels."""
    cohorts = release.cohorts["cohort"].tolist()
    return {COHORT: cohorts, CLASS: [schema.negative, schema.positive]} | {c: schema.bins(c) for c in [*schema.numeric, *schema.categorical] if c != schema.stratify}


def tables_of(release: Release, schema: Schema) -> list[Measured]:
    """Sizes of cohorts, their classes, the columns of each class, and positives and negatives of released cells.

    Each has the noise that its budget implies; the positives of a cell are its support times its rate, and the noise of
    its negatives is that of both queries.
    """
    domain, audit = domains(release, schema), release.audit
    cohorts = domain[COHORT]
    size = release.cohorts["size"].to_numpy(float)
    share = release.cohorts["positive_share"].to_numpy(float)
    classes = size[:, None] * np.stack([1 - share, share], axis=1)
    query = noise_of(audit, "marginals")
    out = [Measured((COHORT,), size, noise_of(audit, "sizes of cohorts")), Measured((COHORT, CLASS), classes, query)]
    known = {k: dict(zip(part["bin"], part["share"])) for k, part in release.marginals.groupby(["cohort", "positive", "col"])}
    for c in list(domain)[2:]:
        table = np.array([[[known[a, p, c].get(b, 0.0) for b in domain[c]] for p in (False, True)] for a in cohorts])
        out.append(Measured((COHORT, CLASS, c), classes[:, :, None] * table / np.maximum(table.sum(axis=2, keepdims=True), 1e-12), query))
    for i, level in enumerate(schema.levels):
        columns = tuple(COHORT if c == schema.stratify else c for c in level)
        labels = [[f"{c}={a}" for a in cohorts] if c == schema.stratify else schema.cells(c) for c in level]
        place = {" & ".join(names) if names else "*": at for names, at in zip(product(*labels), product(*[range(len(x)) for x in labels]))}
        counts = np.full([*[len(x) for x in labels], 2], np.nan)
        for r in release.cells[release.cells["level"] == i].itertuples():
            if r.cell in place:
                counts[place[r.cell]] = r.support * np.array([1 - r.rate, r.rate])
        if np.isfinite(counts).any():
            rates, supports = noise_of(audit, f"rates of level {i}"), noise_of(audit, f"supports of level {i}")
            out.append(Measured((*columns, CLASS), counts, np.array([np.hypot(rates, supports), rates])))
    return out


def fit_release(release: Release, schema: Schema, slack: float = 0.01, rounds: int = 3000, tolerance: float = 1e-7) -> Model:
    """The fit to a release. Every column is joined to cohort and class, and to the columns that share a cell with it."""
    if not len(release.cohorts):
        raise ValueError("the release holds no cohort")
    widths = {c: len(labels) for c, labels in domains(release, schema).items()}
    return fit(widths, tables_of(release, schema), float(release.cohorts["size"].sum()), (COHORT, CLASS), slack, rounds, tolerance)


def apart(model: Model, release: Release, schema: Schema) -> list[tuple[float, str, str]]:
    """Total variation between fitted and released shares of each cohort's columns, the largest first: (distance, cohort, column)."""
    out = []
    for m in tables_of(release, schema):
        if m.columns[:2] == (COHORT, CLASS) and len(m.columns) == 3:
            have, want = model.table(m.columns).sum(axis=1), m.counts.sum(axis=1)
            far = np.abs(have / have.sum(axis=1, keepdims=True) - want / want.sum(axis=1, keepdims=True)).sum(axis=1) / 2
            out += [(float(x), cohort, m.columns[2]) for x, cohort in zip(far, release.cohorts["cohort"])]
    return sorted(out, key=lambda x: (-x[0], x[1:]))
