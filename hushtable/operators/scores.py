"""How well a score tells members or positives from the rest, exactly and without one global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the score's range whose counts are summed up first.
PARTS = 4096


def auc(df: DataFrame, score: Column, positive: Column, rows_each: Column | None = None) -> DataFrame:
    """One row (auc, positives, negatives): the share of pairs of a positive and a negative that the score orders rightly.
    `rows_each` says for how many rows a row stands.

    Ties count half. Rows with a null or NaN score or a null label take no part; without both classes the area is null.
    Scores are counted by value, then in parts of even width whose sums say how many negatives lie before each part.
    """
    rows = df.select(score.cast("double").alias("s"), positive.alias("p"), (F.lit(1) if rows_each is None else rows_each).cast("long").alias("m")).where("s is not null and not isnan(s) and p is not null")
    counts = rows.groupBy("s").agg(*[F.sum(F.when(F.col("p") == p, F.col("m")).otherwise(0)).alias(name) for p, name in ((True, "pos"), (False, "neg"))])
    ends = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col("s") - F.col("lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    counts = counts.crossJoin(F.broadcast(ends)).select("s", "pos", "neg", at.alias("part"))  # one row
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.groupBy("part").agg(F.sum("neg").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    right = F.col("pos").cast("double") * (F.col("before") + F.coalesce(own, F.lit(0)) + F.col("neg") / 2)
    sums = counts.join(F.broadcast(parts), "part").withColumn("right", right)
    out = sums.agg(F.sum("right").alias("u"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(F.when(pairs > 0, F.round(F.col("u") / pairs, 9)).alias("auc"), "positives", "negatives")


def advantage(area: float) -> float:
    """What an attack with this area gains over guessing."""
    return 2 * abs(area - 0.5)


def advantage_bound(epsilon: float) -> float:
    """The most that any attack can gain against a release with this budget."""
    return math.tanh(epsilon / 2)
