"""Cohorts by named bands of public bounds, and categories merged into public groups."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, number, text

#: Label of a value in no band.
OUTSIDE = "oob"


def in_bands(column: str, bands: dict[str, tuple[float, float]]) -> Column:
    """The band [lo, hi) that holds a number, the last one closed; numbers outside all bands and missing ones are `oob`."""
    value, out = number(column), F.lit(OUTSIDE)
    for i, (name, (lo, hi)) in reversed(list(enumerate(bands.items()))):
        upper = value <= hi if i == len(bands) - 1 else value < hi
        out = F.when((value >= lo) & upper, F.lit(name)).otherwise(out)
    return out


def check_bands(schema: Schema, column: str, bands: dict[str, tuple[float, float]]) -> None:
    """Bands must follow one another without a gap, from a column's lowest edge to its highest."""
    edges = [lo for lo, _ in bands.values()] + [list(bands.values())[-1][1]] if bands else []
    joined = all(a[1] == b[0] for a, b in zip(list(bands.values()), list(bands.values())[1:]))
    if not bands or not joined or edges != sorted(set(edges)) or (edges[0], edges[-1]) != (schema.numeric[column][0], schema.numeric[column][-1]):
        raise ValueError(f"the bands of {column} must tile its bounds")


def with_cohorts(df: DataFrame, schema: Schema, parts: dict[str, dict[str, tuple[float, float]] | None], name: str = "cohort") -> tuple[DataFrame, Schema, list[str]]:
    """A table with a column of cohorts, the schema that stratifies by it, and all cohorts of the public domain.

    `parts` maps a numeric column to its bands, a categorical one to None; labels are joined by ` & `. Without parts all
    rows are in the cohort `all`. A row outside all bands is in a cohort outside the domain, which dense counts leave out.
    A missing category makes the cohort null.
    """
    if name in df.columns:
        raise ValueError(f"{name} is already a column")
    for column, bands in parts.items():
        if bands is not None:
            check_bands(schema, column, bands)
    labels = [text(c) if bands is None else in_bands(c, bands) for c, bands in parts.items()]
    key = F.concat(*[x for label in labels for x in (F.lit(" & "), label)][1:]) if parts else F.lit("all")
    every = [" & ".join(p) for p in product(*[schema.categorical[c] if bands is None else bands for c, bands in parts.items()])] if parts else ["all"]
    return df.withColumn(name, key), replace(schema, stratify=name), every


def coarsened(df: DataFrame, schema: Schema, groups: dict[str, dict[str, str]]) -> tuple[DataFrame, Schema]:
    """A table whose categories are replaced by their groups, and the schema that declares these; others pass unchanged."""
    categorical = dict(schema.categorical)
    for column, group in groups.items():
        if column not in categorical or not group or not set(group) <= set(categorical[column]):
            raise ValueError(f"groups of {column} must be of declared categories")
        names = F.create_map(*[F.lit(x) for pair in group.items() for x in pair])
        df = df.withColumn(column, F.coalesce(F.try_element_at(names, text(column)), text(column)))
        categorical[column] = tuple(dict.fromkeys(group.get(v, v) for v in categorical[column]))
    return df, replace(schema, categorical=categorical)
