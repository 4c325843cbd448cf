"""Bins, cohort keys and cell keys as native column expressions over public edges and categories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schema:
    """A public description of a private table; nothing in it is read from data.

    numeric: column to its bin edges, ascending; categorical: column to its declared values; the target has two labels;
    cohorts are the declared values of `stratify`; levels are tuples of columns.
    """

    numeric: dict[str, Sequence[float]]
    categorical: dict[str, Sequence[str]]
    target: str
    positive: str
    negative: str
    stratify: str
    levels: tuple[tuple[str, ...], ...] = field(default=())

    def __post_init__(self):
        for column, edges in self.numeric.items():
            if len(edges) < 2 or list(edges) != sorted(set(edges)):
                raise ValueError(f"edges of {column} must ascend")
        for column, values in self.categorical.items():
            if not values or len(set(values)) != len(values):
                raise ValueError(f"values of {column} must differ")
        if self.positive == self.negative or self.target in self.numeric or self.target in self.categorical:
            raise ValueError("the target needs two labels and must not be a feature")

    def bins(self, column: str) -> list[str]:
        """The public domain of a column's bins, as labels."""
        if column in self.numeric:
            return [str(i) for i in range(len(self.numeric[column]) - 1)]
        return [self.negative, self.positive] if column == self.target else list(self.categorical[column])


    def cells(self, column: str) -> list[str]:
        """The same domain as parts of a cell's key: column[a,b) for numbers, column=value else."""
        if column in self.numeric:
            return [f"{column}[{a:g},{b:g})" for a, b in zip(self.numeric[column], self.numeric[column][1:])]
        return [f"{column}={value}" for value in self.bins(column)]


def number(column: str) -> Column:
    """A numeric value, null if it can't be read as one or is NaN."""
    value = F.expr(f"try_cast(`{column}` as double)")
    return F.when(~F.isnan(value), value)


def histogram_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bins [a, b), the last closed; values outside are null."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = value <= edges[i + 1] if i == len(edges) - 2 else value < edges[i + 1]
        out = F.when((value >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out


def cell_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bins [a, b); values outside fall in the boundary bins, a missing value in the top one."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        out = F.when(value < edges[i + 1], F.lit(i)).otherwise(out)
    return out


def selection_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bins [a, b) by inner edges only: values outside fall in the boundary bins, a missing value in the first."""
    out = F.lit(0)
    for i in range(1, len(edges) - 1):
        out = F.when(value >= edges[i], F.lit(i)).otherwise(out)
    return out


def half_open_band(value: Column, edges: Sequence[float]) -> Column:
    """Bands [a, b), the last one open too; values outside and missing ones are `nan`."""
    out = F.lit("nan")
    for i in range(len(edges) - 1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(str(i))).otherwise(out)
    return out


def clipped_band(column: str, edges: Sequence[float]) -> Column:
    """Bands (a, b] of values clipped to the outer edges; a missing value has none."""
    value = clipped(column, edges)
    return F.when(value.isNotNull(), band(value, edges))


def whole(value: Column) -> Column:
    """A text without the .0 that a whole number read as a fraction ends with."""
    return F.regexp_replace(F.trim(value), r"^(-?\d+)\.0$", "$1")


def band(value: Column, edges: Sequence[float]) -> Column:
    """Bands (a, b], the lowest edge included, as labels; values outside and missing ones are the category `nan`."""
    out = F.lit("nan")
    for i in range(len(edges) - 2, -1, -1):
        lower = value >= edges[i] if i == 0 else value > edges[i]
        out = F.when(lower & (value <= edges[i + 1]), F.lit(str(i))).otherwise(out)
    return out


def text(column: str) -> Column:
    return F.trim(F.col(column).cast("string"))


def clipped(column: str, edges: Sequence[float]) -> Column:
    value = number(column)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(edges[-1]))), F.lit(float(edges[0]))))


def undiscretise(bins: Column, edges, u: Column, whole: bool) -> Column:
    """A value drawn evenly in its bin; of whole numbers, only the last bin's upper edge belongs to it."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    low, high = F.element_at(e, bins + 1), F.element_at(e, bins + 2)
    if not whole:
        return low + u * (high - low)
    top = F.when(bins == len(edges) - 2, high).otherwise(high - 1)
    return F.least(F.floor(low + u * (top - low + 1)).cast("double"), top)
