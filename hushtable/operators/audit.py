"""Checks of a table against its schema, counts of what was emitted, and orders and pairings that reports need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, half_open_band, number, selection_bin, text
from hushtable.operators.counts import domain


def problems(df: DataFrame, schema: Schema) -> DataFrame:
    """What a table has against its schema, from one pass: (col, problem, n), without a row for what is in order.

    Problems are: missing (null), unreadable (no number), outside (beyond the edges), undeclared (a value or label that the
    schema doesn't name). An empty table has none.
    """
    found = []
    for c, edges in schema.numeric.items():
        v = number(c)
        found += [(c, "missing", F.col(c).isNull()), (c, "unreadable", F.col(c).isNotNull() & v.isNull()), (c, "outside", (v < edges[0]) | (v > edges[-1]))]
    for c in [*schema.categorical, schema.target]:
        found += [(c, "missing", F.col(c).isNull()), (c, "undeclared", ~text(c).isin(schema.bins(c)))]
    sums = df.agg(*[F.count_if(test).alias(f"_{i}") for i, (_, _, test) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(what).alias("problem"), F.col(f"_{i}").alias("n")) for i, (c, what, _) in enumerate(found)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def require(df: DataFrame, schema: Schema, allowed: tuple[str, ...] = ("outside",)) -> DataFrame:
    """The table itself, or a ValueError that names its problems; values outside the edges are allowed, as they are clipped."""
    lacking = [c for c in [*schema.numeric, *schema.categorical, schema.target] if c not in df.columns]
    if lacking:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    bad = problems(df, schema).where(~F.col("problem").isin(list(allowed))).collect()
    if bad:
        raise ValueError("; ".join(f"{r['col']}: {r['n']} {r['problem']}" for r in bad))
    return df


def emitted_counts(df: DataFrame, schema: Schema, cohorts: list[str]) -> DataFrame:
    """How many rows of each cohort and class are in each bin: (cohort, positive, col, bin, n); empty bins have no row."""
    binned = lambda c: selection_bin(number(c), schema.numeric[c]).cast("string") if c in schema.numeric else text(c)
    parts = [F.struct(F.lit(c).alias("col"), binned(c).alias("bin")) for c in [*schema.numeric, *schema.categorical]]
    rows = df.select(text(schema.stratify).alias("cohort"), (text(schema.target) == schema.positive).alias("positive"), F.explode(F.array(*parts)).alias("p"))
    return rows.where(F.col("cohort").isin(cohorts)).groupBy("cohort", "positive", "p.col", "p.bin").agg(F.count("*").alias("n"))


def marginal_shift(before: DataFrame, after: DataFrame, schema: Schema) -> DataFrame:
    """Mean total variation over the categorical columns between a table and its changed copy: one row, `shift`."""
    parts = [F.struct(F.lit(c).alias("col"), F.coalesce(text(c), F.lit("nan")).alias("bin")) for c in schema.categorical]
    side = lambda df, s: df.select(F.explode(F.array(*parts)).alias("p"), F.lit(s).alias("s")).select("p.*", "s")
    counts = side(before, 0).union(side(after, 1)).groupBy("col", "bin").agg(*[F.count_if(F.col("s") == s).alias(f"n{s}") for s in (0, 1)])
    of = Window.partitionBy("col")
    apart = counts.select("col", F.abs(F.col("n0") / F.sum("n0").over(of) - F.col("n1") / F.sum("n1").over(of)).alias("d"))
    return apart.groupBy("col").agg((F.sum("d") / 2).alias("d")).agg(F.round(F.avg("d"), 9).alias("shift"))


def band_rates(df: DataFrame, schema: Schema, column: str) -> DataFrame:
    """Rows and positive rate of each half-open band of a number, those outside as `nan`."""
    rows = df.groupBy(half_open_band(number(column), schema.numeric[column]).alias("band"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((text(schema.target) == schema.positive).cast("int")), 9).alias("rate"))


def mass_between(shares: Column, edges, low: Column, high: Column) -> Column:
    """The share of a histogram (an array of shares by bin) between two bounds, spread evenly within each bin."""
    parts = [F.element_at(shares, i + 1) * F.greatest(F.least(high, F.lit(float(b))) - F.greatest(low, F.lit(float(a))), F.lit(0.0)) / float(b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return reduce(Column.__add__, parts)


def mixture(positive: Column, negative: Column, weight: Column, renormalise: bool = True) -> Column:
    """The histogram of a cohort from those of its classes: weight * positive + (1 - weight) * negative, summing up to 1."""
    mixed = F.zip_with(positive, negative, lambda p, q: weight * p + (1 - weight) * q)
    total = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(mixed, lambda x: x / total)).otherwise(mixed) if renormalise else mixed


def band_coverage(marginals: DataFrame, cells: DataFrame, schema: Schema) -> DataFrame:
    """The share of each conditioning column's released mass that lies in bins which a released cell names.

    `marginals` has (cohort, size, col, bin, share), `cells` has (cell); cohorts count by their sizes.
    """
    named = cells.select(F.explode(F.split("cell", " & ")).alias("part")).distinct()
    labels = [(c, b, part) for c in [*schema.numeric, *schema.categorical] for b, part in zip(schema.bins(c), schema.cells(c))]
    label = cells.sparkSession.createDataFrame(labels, "col string, bin string, part string")  # the public domain
    known = label.join(named, "part", "left_semi").select("col", "bin").withColumn("named", F.lit(True))
    used = known.select("col").distinct()
    rows = marginals.join(used, "col", "left_semi").join(known, ["col", "bin"], "left")
    covered = F.sum(F.when(F.col("named"), F.col("share") * F.col("size")).otherwise(0.0))
    return rows.groupBy("col").agg(F.round(covered / F.sum(F.col("share") * F.col("size")), 9).alias("covered"))


def numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds `number`: from 0 on within each value of `by`, in the given order. For groups that fit in a task each."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def as_texts(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Rows sorted by columns compared as texts (so that 10 comes before 2), ties by ids."""
    return df.orderBy(*[F.col(c).cast("string") for c in columns], *ids)


def extremes(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """The k largest and the k smallest values as a report lists them: (side, name, value)."""
    worst = df.orderBy(F.desc(value), name).limit(k).select(F.lit("worst").alias("side"), name, value)
    return worst.union(df.orderBy(value, name).limit(k).select(F.lit("best").alias("side"), name, value))


def renamed(df: DataFrame, columns: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """A table under neutral names: columns, and declared values by column (by the old names). Other values become null.

    Both maps must be one to one, so that the inverse maps give the table back.
    """
    if any(len(set(m.values())) != len(m) for m in (columns, *values.values())):
        raise ValueError("two names would become one")
    out = df
    for c, names in values.items():
        out = out.withColumn(c, F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), text(c)))
    return out.withColumnsRenamed(columns)


def distinct_seen(df: DataFrame, schema: Schema) -> DataFrame:
    """How many declared values of each column are there, and how many that aren't declared: (col, declared, seen, other)."""
    parts = [F.struct(F.lit(c).alias("col"), text(c).alias("value")) for c in [*schema.categorical, schema.target]]
    seen = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("value is not null").distinct()
    every = reduce(DataFrame.unionByName, (domain(df, col=[c], value=schema.bins(c)).withColumn("known", F.lit(True)) for c in [*schema.categorical, schema.target]))
    both = every.join(seen.withColumn("there", F.lit(True)), ["col", "value"], "full")
    return both.groupBy("col").agg(
        F.count("known").alias("declared"), F.count_if(F.col("known") & F.col("there")).alias("seen"), F.count_if(F.col("known").isNull()).alias("other")
    )
