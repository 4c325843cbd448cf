"""Dense counts: every cell of the public domain has a row, whether the data have it or not."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, band, cell_bin, clipped, histogram_bin, number, text


def coerce(df: DataFrame, schema: Schema) -> DataFrame:
    """Numbers read and clipped to their bounds, texts stripped, rows with a missing number dropped."""
    numbers = [clipped(c, e).alias(c) for c, e in schema.numeric.items()]
    texts = [text(c).alias(c) for c in dict.fromkeys([*schema.categorical, schema.target, schema.stratify])]
    return df.select(*numbers, *texts).na.drop(subset=list(schema.numeric))


def domain(df: DataFrame, **columns: list) -> DataFrame:
    """The product of public values, as a small table whose size the schema bounds."""
    if not columns:
        return df.sparkSession.range(1).drop("id")
    kinds = {bool: pa.bool_(), int: pa.int32(), float: pa.float64()}
    rows = list(product(*columns.values()))
    return df.sparkSession.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], kinds.get(type(values[0]) if len(values) else str, pa.string())) for i, (c, values) in enumerate(columns.items())}))


def signatures(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows counted by all columns at once (and `n`): what is then dealt to many sets of columns is no longer rows, but at
    most the public domain's signatures."""
    return df.groupBy(*[value.alias(name) for name, value in columns.items()]).agg(F.count("*").alias("n"))


def long_bins(df: DataFrame, schema: Schema, binned) -> DataFrame:
    """A row for each signature and column: (cohort, positive, col, bin, n)."""
    names = [*schema.numeric, *schema.categorical]
    own = {f"_{i}": binned(c).cast("string") for i, c in enumerate(names)}
    counted = signatures(df, {"cohort": F.col(schema.stratify), "positive": F.col(schema.target) == schema.positive} | own)
    parts = [F.struct(F.lit(c).alias("col"), F.col(at).alias("bin")) for c, at in zip(names, own)]
    return counted.select("cohort", "positive", "n", F.explode(F.array(*parts)).alias("p")).select("cohort", "positive", "p.*", "n")


def dense_histogram(df: DataFrame, schema: Schema, cohorts: list[str]) -> DataFrame:
    """Counts of every bin of every column in every cohort, from one pass."""
    rows = coerce(df, schema)
    binned = lambda c: histogram_bin(F.col(c), schema.numeric[c]) if c in schema.numeric else F.col(c)
    counts = long_bins(rows, schema, binned).groupBy("cohort", "col", "bin").agg(F.sum("n").alias("n"))
    every = reduce(DataFrame.unionByName, (domain(df, cohort=cohorts, col=[c], bin=schema.bins(c)) for c in [*schema.numeric, *schema.categorical]))
    return every.join(counts, ["cohort", "col", "bin"], "left").na.fill(0, ["n"])


def class_balance(df: DataFrame, schema: Schema, cohorts: list[str]) -> DataFrame:
    """Size, positives and positive share of every cohort; the share of an empty one is null."""
    rows = coerce(df, schema)
    counts = rows.groupBy(F.col(schema.stratify).alias("cohort")).agg(F.count("*").alias("n"), F.count_if(F.col(schema.target) == schema.positive).alias("positives"))
    out = domain(df, cohort=cohorts).join(counts, "cohort", "left").na.fill(0)
    return out.withColumn("share", F.when(F.col("n") > 0, F.round(F.col("positives") / F.col("n"), 5)))


def histogram_moments(df: DataFrame, schema: Schema, cohorts: list[str]) -> DataFrame:
    """Mean and spread of every numeric column in every cohort as its histogram tells them, from bin centres."""
    centres = reduce(DataFrame.unionByName, (domain(df, col=[c], bin=[str(i)], centre=[(e[i] + e[i + 1]) / 2]) for c, e in schema.numeric.items() for i in range(len(e) - 1)))
    h = dense_histogram(df, schema, cohorts).join(F.broadcast(centres), ["col", "bin"])
    out = h.groupBy("cohort", "col").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("centre")).alias("s"), F.sum(F.col("n") * F.col("centre") * F.col("centre")).alias("q")).where("n > 0")
    mean = F.col("s") / F.col("n")
    return out.select("cohort", "col", F.round(mean, 3).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 3).alias("std"))


def cell(schema: Schema, column: str) -> Column:
    if column in schema.numeric:
        return F.element_at(F.array(*map(F.lit, schema.cells(column))), cell_bin(number(column), schema.numeric[column]) + 1)
    return F.concat(F.lit(f"{column}="), text(column))


def cell_key(schema: Schema, columns) -> Column:
    """The key of a row's cell; the level without columns has the one cell `*`."""
    return F.concat_ws(" & ", *[cell(schema, c) for c in columns]) if columns else F.lit("*")


def cell_rates(df: DataFrame, schema: Schema) -> DataFrame:
    """Support, positives and positive rate of every cell of every level, over the dense domain; one pass for all levels."""
    keys = [F.struct(F.lit(i).alias("level"), cell_key(schema, level).alias("cell")) for i, level in enumerate(schema.levels)]
    rows = df.select(F.explode(F.array(*keys)).alias("k"), (text(schema.target) == schema.positive).alias("positive")).select("k.*", "positive")
    counts = rows.groupBy("level", "cell").agg(F.count("*").alias("support"), F.count_if(F.col("positive")).alias("positives"))
    every = []
    for i, level in enumerate(schema.levels):
        d = domain(df, **{f"c{k}": schema.cells(c) for k, c in enumerate(level)})
        every.append(d.select(F.lit(i).alias("level"), (F.concat_ws(" & ", *d.columns) if level else F.lit("*")).alias("cell")))
    out = reduce(DataFrame.unionByName, every).join(counts, ["level", "cell"], "left").na.fill(0)
    return out.withColumn("rate", F.when(F.col("support") > 0, F.round(F.col("positives") / F.col("support"), 5)))


def mutual_information(df: DataFrame, schema: Schema) -> DataFrame:
    """Mutual information of each column's bands with the target, in nats; columns without rows have none."""
    rows = long_bins(df, schema, lambda c: band(number(c), schema.numeric[c]) if c in schema.numeric else text(c))
    joint = rows.groupBy("col", "bin", "positive").agg(F.sum("n").alias("n"))
    summed = lambda *by: F.sum("n").over(Window.partitionBy("col", *by))  # noqa: E731 (over the domain's few counts)
    out = joint.withColumns({"nb": summed("bin"), "nc": summed("positive"), "nt": summed()})
    return out.groupBy("col").agg(F.round(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nc")))), 9).alias("mi"))


def one_way_distance(real: DataFrame, other: DataFrame, schema: Schema) -> DataFrame:
    """Total variation of each column's bands between two tables, the target's too, and their mean: half the summed
    difference of shares."""
    return _set_distance(real, other, schema, 1)


def two_way_distance(real: DataFrame, other: DataFrame, schema: Schema) -> DataFrame:
    """Total variation of every pair of columns, those with the target too, and their mean."""
    return _set_distance(real, other, schema, 2)


def _set_distance(real: DataFrame, other: DataFrame, schema: Schema, k: int) -> DataFrame:
    binned = lambda c: band(number(c), schema.numeric[c]) if c in schema.numeric else F.coalesce(text(c), F.lit("nan"))
    names = [*schema.numeric, *schema.categorical, schema.target]
    return _distance(dealt(real, other, {c: binned(c) for c in names}, list(combinations(names, k))), {"mean": F.lit(True)})


def dealt(real: DataFrame, other: DataFrame, binned: dict[str, Column], sets: list[tuple[str, ...]]) -> DataFrame:
    """The signatures of two tables (side 1 and -1) dealt to sets of columns: (col, bin, side, n)."""
    place = {c: f"_{i}" for i, c in enumerate(binned)}
    parts = [F.struct(F.lit("|".join(c)).alias("col"), F.concat_ws("|", *[place[x] for x in c]).alias("bin")) for c in sets]
    side = lambda df, s: signatures(df, {place[c]: value for c, value in binned.items()}).select(F.explode(F.array(*parts)).alias("p"), "n").select("p.*", "n").withColumn("side", F.lit(s))
    return side(real, 1).unionByName(side(other, -1))


def _distance(both: DataFrame, means: dict[str, Column]) -> DataFrame:
    """The distance of each `col` from one aggregation, and a row for each named mean over the columns of a condition."""
    counts = both.groupBy("col", "bin").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(name) for s, name in ((1, "a"), (-1, "b"))])
    of = Window.partitionBy("col")
    share = lambda n: F.when(F.sum(n).over(of) > 0, F.col(n) / F.sum(n).over(of)).otherwise(F.lit(0.0))
    apart = counts.select("col", F.abs(share("a") - share("b")).alias("apart")).groupBy("col").agg((F.sum("apart") / 2).alias("d"))
    named = F.array(F.col("col"), *[F.when(condition, F.lit(name)) for name, condition in means.items()])
    rows = apart.select(F.explode(named).alias("name"), "d").where("name is not null")
    return rows.groupBy(F.col("name").alias("col")).agg(F.round(F.avg("d"), 9).alias("distance"))


def conditional_error(real: DataFrame, other: DataFrame, schema: Schema) -> DataFrame:
    """Mean absolute difference of the positive rates of cells that both tables have, for each level."""
    a = cell_rates(real, schema).where("support > 0").select("level", "cell", (F.col("positives") / F.col("support")).alias("p"))
    b = cell_rates(other, schema).where("support > 0").select("level", "cell", (F.col("positives") / F.col("support")).alias("q"))
    return a.join(b, ["level", "cell"]).groupBy("level").agg(F.count("*").alias("cells"), F.round(F.avg(F.abs(F.col("p") - F.col("q"))), 9).alias("error"))


def absent_categories(df: DataFrame, schema: Schema) -> DataFrame:
    """Declared values that no row has."""
    every = reduce(DataFrame.unionByName, (domain(df, col=[c], value=list(v)) for c, v in schema.categorical.items()))
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), text(c).alias("value")) for c in schema.categorical])).alias("p")).select("p.*").distinct()
    return every.join(seen, ["col", "value"], "left_anti")


def noisy_histogram(df: DataFrame, schema: Schema, cohorts: list[str], epsilon: float, seed: int) -> DataFrame:
    """The dense histogram under Laplace noise of scale (columns / epsilon), clamped at 0 and made into shares.

    Only the public domain's counts come to the driver; noise is drawn there once, so that no recomputation draws anew.
    """
    import numpy as np

    rows = dense_histogram(df, schema, cohorts).orderBy("cohort", "col", "bin").toPandas()
    scale = (len(schema.numeric) + len(schema.categorical)) / epsilon
    rows["noisy"] = np.maximum(rows["n"] + np.random.default_rng(seed).laplace(0, scale, len(rows)), 0)
    total = rows.groupby(["cohort", "col"])["noisy"].transform("sum")
    size = rows.groupby(["cohort", "col"])["noisy"].transform("size")
    rows["share"] = (rows["noisy"] / total.where(total > 0)).fillna(1 / size)
    return df.sparkSession.createDataFrame(rows[["cohort", "col", "bin", "share"]])
