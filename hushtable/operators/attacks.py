"""Attacks that try to tell training rows from others by a synthetic table, and how sure their success is."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, clipped, text
from hushtable.operators.closest import _names, features
from hushtable.operators.near_points import k_nearest

#: Rows of distances at once in a task, and candidates that are scored in one pass.
CELLS, CANDIDATES = 2_000_000, 20_000
#: Rows that a forest learns from for each different row at most; they share its rows' weight.
PIECES = 4
#: Ranges of scores; each is drawn anew in one task, over its different scores.
RANGES = 64


def auc_interval(df: DataFrame, score: Column, positive: Column, draws: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (auc, low, high, positives, negatives): the area under the curve and an interval from resampled rows.

    Each draw gives every row a Poisson weight with mean 1, which is what drawing as many rows with replacement comes to.
    Rows of one score and class are weighed together, as their weights add up to a Poisson number with their count as mean:
    one pass counts them, ranges of scores are drawn apart, and the ranges' sums (3 numbers each draw) are put together.
    Rows without a score or class take no part; without both classes all three are null.
    """
    rows = df.select(score.cast("double").alias("s"), positive.alias("p")).where("s is not null and not isnan(s) and p is not null")
    counts = rows.groupBy("s").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg")).persist()
    cuts = sorted(set(counts.approxQuantile("s", [i / RANGES for i in range(1, RANGES)], 0.005))) if counts.take(1) else []
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x <= F.col("s")))

    def redrawn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s")
        n = int(frame["part"].iloc[0])
        out = []
        for at in range(0, draws + 1, 64):
            own = range(at, min(at + 64, draws + 1))
            rng = np.random.default_rng([seed, n, at])
            pos, neg = (frame[c].to_numpy()[:, None] * np.ones(len(own), np.int64) for c in ("pos", "neg"))
            if at == 0:  # number 0 is the rows themselves
                pos[:, 1:], neg[:, 1:] = rng.poisson(pos[:, 1:]), rng.poisson(neg[:, 1:])
            else:
                pos, neg = rng.poisson(pos), rng.poisson(neg)
            right = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
            out.append(pd.DataFrame({"part": n, "draw": list(own), "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "right": right}))
        return pd.concat(out)

    ranges = counts.withColumn("part", part).groupBy("part").applyInPandas(redrawn, "part int, draw int, pos double, neg double, right double")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = ranges.withColumn("before", before).groupBy("draw").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("right") + F.col("pos") * F.col("before")).alias("u"))
    areas = sums.withColumn("auc", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))))
    tail = (1 - level) / 2
    ends = [F.expr(f"percentile(auc, {x}) filter (where draw > 0)") for x in (tail, 1 - tail)]
    first = lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    out = areas.agg(first("auc").alias("auc"), ends[0].alias("low"), ends[1].alias("high"), F.coalesce(first("pos"), F.lit(0.0)).cast("long").alias("positives"), F.coalesce(first("neg"), F.lit(0.0)).cast("long").alias("negatives"))
    return out.select(*[F.when(F.col("auc").isNotNull(), F.round(c, 9)).alias(c) for c in ("auc", "low", "high")], "positives", "negatives")


def vector(schema: Schema) -> Column:
    """Numbers scaled by their bounds (a missing one at the lowest), declared values of categories and labels as 0 or 1."""
    parts = [(F.coalesce(clipped(c, e), F.lit(float(e[0]))) - float(e[0])) / (float(e[-1]) - float(e[0])) for c, e in schema.numeric.items()]
    for c in dict.fromkeys([*schema.categorical, schema.target]):
        parts += [F.coalesce((text(c) == v).cast("double"), F.lit(0.0)) for v in schema.bins(c)]
    return F.array(*parts)


def nearest_scores(synthetic: DataFrame, candidates: DataFrame, schema: Schema) -> DataFrame:
    """The nearer the nearest synthetic row, the higher the score: (member, score)."""
    columns, names = features(schema), _names(schema)
    asked = candidates.select("member", *columns)
    found = k_nearest(asked, synthetic.select(*columns), names, len(schema.numeric), 1)
    return asked.join(found.select(*names, (-F.col("distance")).alias("score")), names, "left").select("member", "score")


def exact_scores(synthetic: DataFrame, candidates: DataFrame, schema: Schema) -> DataFrame:
    """1 for a candidate that the synthetic table has, else 0."""
    columns = list(dict.fromkeys([*schema.numeric, *schema.categorical, schema.target]))
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("_key")
    have = synthetic.select(*[F.col(c).cast("string") for c in columns]).distinct().select(key).distinct().withColumn("_have", F.lit(1.0))
    return candidates.select("member", key).join(have, "_key", "left").select("member", F.coalesce("_have", F.lit(0.0)).alias("score"))


def _counted(df: DataFrame, schema: Schema, *found: Column) -> DataFrame:
    """Rows that `vector` can't tell apart once, with what `found` adds up of them: private tables have far fewer different
    rows than rows."""
    numbers = [F.coalesce(clipped(c, e), F.lit(float(e[0]))).alias(c) for c, e in schema.numeric.items()]
    values = [F.when(text(c).isin(schema.bins(c)), text(c)).alias(c) for c in dict.fromkeys([*schema.categorical, schema.target])]
    return df.groupBy(*numbers, *values).agg(*found)


def _sides(candidates: DataFrame, schema: Schema) -> DataFrame:
    return _counted(candidates, schema, F.count_if("member").alias("_in"), F.count_if(~F.col("member")).alias("_out")).select(vector(schema).alias("_x"), "_in", "_out")


def _each(told: DataFrame) -> DataFrame:
    """A row (member, score) for each candidate."""
    sides = F.array(F.struct(F.lit(True).alias("member"), F.col("_in").alias("n")), F.struct(F.lit(False).alias("member"), F.col("_out").alias("n")))
    side = told.select("score", F.explode(sides).alias("_side")).where("_side.n > 0")
    return side.select(F.col("_side.member").alias("member"), "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_side.n")))).select("member", "score")


def shadow_scores(synthetic: DataFrame, candidates: DataFrame, schema: Schema, ids: list[str], trees: int = 100, depth: int = 8, seed: int = 0) -> DataFrame:
    """How much a candidate looks like a synthetic row to a forest that learned to tell those from candidates.

    Of the larger side as many rows as the smaller has, give or take their root, are chosen by hash for learning. Up to PIECES
    equal rows are learned from one by one, more as so many pieces that weigh as much as all of them.
    """
    sizes = [df.count() for df in (synthetic, candidates)]
    if not all(sizes):
        return candidates.select("member", F.lit(0.5).alias("score"))
    parts, train = candidates.sparkSession.sparkContext.defaultParallelism, []
    for df, n, label in zip((synthetic, candidates), sizes, (1.0, 0.0)):
        kept = df.where((F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 30)) / float(1 << 30)) < min(sizes) / n)
        train.append(_counted(kept, schema, F.count("*").alias("_n")).select(vector(schema).alias("_x"), "_n", F.lit(label).alias("label")))
    pieces = F.least("_n", F.lit(PIECES).cast("long"))
    rows = train[0].unionByName(train[1]).repartition(parts, "_x").sortWithinPartitions("_x", "label")  # the draws go by place
    rows = rows.select(array_to_vector("_x").alias("features"), "label", (F.col("_n") / pieces).alias("_weight"), F.explode(F.sequence(F.lit(1).cast("long"), pieces)))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="_weight").fit(rows)
    told = model.transform(_sides(candidates, schema).select("_in", "_out", array_to_vector("_x").alias("features")))
    return _each(told.select(vector_to_array("probability")[1].alias("score"), "_in", "_out"))


def _components(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, their principal axes in columns, and the variance along each, greatest first; each task sends
    one matrix of sums."""

    def sums(frames):
        total = np.zeros((width + 1, width + 1))
        for frame in frames:
            x = np.c_[np.array(frame["_x"].tolist(), float).reshape(-1, width), np.ones(len(frame))]
            total += x.T @ (x * frame["_n"].to_numpy(float)[:, None])
        yield pd.DataFrame({"total": [total.ravel()]})

    total = np.sum([r[0] for r in rows.select("_x", "_n").mapInPandas(sums, "total array<double>").collect()], axis=0).reshape(width + 1, width + 1)
    n = total[-1, -1]
    if not n:
        return 0, np.eye(width), np.zeros(width)
    mean = total[-1, :-1] / n
    spread, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return int(round(n)), axes[:, ::-1], spread[::-1]


def likelihood_scores(synthetic: DataFrame, candidates: DataFrame, schema: Schema, ids: list[str], shadows: int = 16, seed: int = 0, most: int = CANDIDATES) -> DataFrame:
    """How likely a candidate is under kernel densities of resampled synthetic rows: the mean of its log density over its spread.

    A synthetic row has a Poisson weight in each resample, a hash of its ids. Equal rows' weights are added up first, so that
    principal components and all resamples are one pass each over different rows. Candidates, a stated set, are taken in blocks
    of about `most`: each block goes to all tasks, which send back a sum and a largest exponent for each candidate and resample.
    """
    weight = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *ids), F.lit(1 << 40)) / float(1 << 40) for i in range(shadows)]
    law = np.cumsum([1 / np.e / float(np.prod(np.arange(1, j + 1))) for j in range(12)]).tolist()
    drawn = [F.sum(reduce(lambda a, b: a + b, [(w >= p).cast("double") for p in law])).alias(f"_w{i}") for i, w in enumerate(weight)]
    spark, parts = synthetic.sparkSession, []
    held = _counted(synthetic, schema, *drawn, F.count("*").alias("_n")).select(vector(schema).alias("_x"), F.array(*[f"_w{i}" for i in range(shadows)]).alias("_w"), "_n")
    held = held.repartition(spark.sparkContext.defaultParallelism).persist()
    width = len(schema.numeric) + sum(len(schema.bins(c)) for c in dict.fromkeys([*schema.categorical, schema.target]))
    n, axes, spread = _components(held, width)
    if not n:
        return candidates.select("member", F.lit(0.0).alias("score"))
    k = min(12, width, max(2, n // 20))
    axes = np.ascontiguousarray(axes[:, :k])
    weights = np.array(held.agg(*[F.sum(F.col("_w")[i]) for i in range(shadows)]).first(), float)
    width_of = max(float(np.sqrt(max(np.mean(spread[:k]), 0.0))) * n ** (-1.0 / (k + 4)), 1e-3)
    shift = -np.log(np.maximum(weights, 1e-300)) - k / 2 * np.log(2 * np.pi * width_of**2)
    asked = _sides(candidates, schema).persist()
    blocks = max(1, -(-asked.count() // most))
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("_x"), F.lit(blocks)) == block).toPandas()
        points = np.array(part["_x"].tolist(), float).reshape(-1, width) @ axes
        sent = spark.sparkContext.broadcast(points)

        def summed(frames, sent=sent):
            c = sent.value
            top, total = np.full(len(c), -np.inf), np.zeros((shadows, len(c)))
            step = max(1, CELLS // max(len(c), 1))
            for frame in frames:
                p, w = np.array(frame["_x"].tolist(), float).reshape(-1, width) @ axes, np.array(frame["_w"].tolist(), float)
                for at in range(0, len(p), step):
                    e = _exponents(p[at : at + step], c, width_of)
                    high = np.maximum(top, e.max(axis=0))
                    total = total * np.exp(top - high) + w[at : at + step].T @ np.exp(e - high)
                    top = high
            which, at = np.nonzero(total > 0)
            yield pd.DataFrame({"at": at, "i": which, "top": top[at], "total": total[which, at]})

        found = held.mapInPandas(summed, "at long, i int, top double, total double")
        high = F.max("top").over(Window.partitionBy("at", "i"))
        found = found.withColumn("_m", high).groupBy("at", "i").agg(F.max("_m").alias("m"), F.sum(F.exp(F.col("top") - F.col("_m")) * F.col("total")).alias("t"))
        table = found.where("t > 0").toPandas()
        logs = np.full((shadows, len(points)), np.nan)
        logs[table["i"], table["at"]] = table["m"] + np.log(table["t"]) + shift[table["i"].to_numpy()]
        logs = np.where(np.isnan(logs), np.nanmin(logs, initial=0.0), logs)
        stat = logs.mean(axis=0) / (logs.std(axis=0) + 1e-9)
        parts.append(spark.createDataFrame([(float(s), int(a), int(b)) for s, a, b in zip(stat, part["_in"], part["_out"])], "score double, _in long, _out long"))
    return _each(reduce(DataFrame.unionByName, parts))


def _exponents(p: np.ndarray, c: np.ndarray, width: float) -> np.ndarray:
    out = np.zeros((len(p), len(c)))
    for j in range(p.shape[1]):
        out -= (p[:, j, None] - c[None, :, j]) ** 2
    return out / (2 * width**2)


def attacked(synthetic: DataFrame, members: DataFrame, others: DataFrame, schema: Schema, ids: list[str], seed: int = 0, draws: int = 2000, names: tuple[str, ...] = ("nearest", "exact", "shadow", "likelihood")) -> DataFrame:
    """Each attack's success at telling members from others: (attack, auc, low, high, advantage, chance).

    `chance` says that the interval holds one half. The candidates are stated sets of rows; `ids` tell rows of a table apart.
    """
    candidates = members.withColumn("member", F.lit(True)).unionByName(others.withColumn("member", F.lit(False)))
    made = {
        "nearest": lambda: nearest_scores(synthetic, candidates, schema),
        "exact": lambda: exact_scores(synthetic, candidates, schema),
        "shadow": lambda: shadow_scores(synthetic, candidates, schema, ids, seed=seed),
        "likelihood": lambda: likelihood_scores(synthetic, candidates, schema, ids, seed=seed),
    }
    out = []
    for name in names:
        told = auc_interval(made[name](), F.col("score"), F.col("member"), draws, seed=seed)
        gained = F.round(2 * F.abs(F.col("auc") - 0.5), 9)
        out.append(told.select(F.lit(name).alias("attack"), "auc", "low", "high", gained.alias("advantage"), ((F.col("low") <= 0.5) & (F.col("high") >= 0.5)).alias("chance")))
    return reduce(DataFrame.unionByName, out)


def controlled(synthetic: DataFrame, members: DataFrame, others: DataFrame, schema: Schema, ids: list[str], seed: int = 0, draws: int = 2000, names: tuple[str, ...] = ("nearest", "exact", "shadow", "likelihood")) -> DataFrame:
    """The attacks on a synthetic table beside the same attacks on the members themselves passed off as one (`control`).

    An attack that finds nothing in the control is blind, and says nothing about the table: `works` is false.
    """
    own = attacked(synthetic, members, others, schema, ids, seed, draws, names)
    control = attacked(members, members, others, schema, ids, seed, draws, names)
    sure = control.select("attack", F.col("advantage").alias("control"), (~F.col("chance")).alias("works"))
    return own.join(sure, "attack")
