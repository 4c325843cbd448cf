"""How near some rows lie to a private table, and whether they lie nearer to it than to rows it never held."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, clipped, text

#: Cells of a block of distances; with its temporary copies a task holds about 100 MB.
CELLS = 4_000_000


def features(schema: Schema) -> list[Column]:
    """Numbers scaled to [0, 1] by their bounds, a missing one at the lowest; categories as places, -1 if not declared."""
    out = []
    for c, e in schema.numeric.items():
        out.append(((F.coalesce(clipped(c, e), F.lit(float(e[0]))) - float(e[0])) / (float(e[-1]) - float(e[0]))).alias(f"_n_{c}"))
    for c, values in schema.categorical.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), text(c)) - 1
        out.append(F.coalesce(place, F.lit(-1)).cast("double").alias(f"_c_{c}"))
    return out


def _names(schema: Schema) -> list[str]:
    return [f"_n_{c}" for c in schema.numeric] + [f"_c_{c}" for c in schema.categorical]


def _least(points: pd.DataFrame, rows: DataFrame, schema: Schema) -> DataFrame:
    """The least distance of each point, named by its place `at`, to the features in `rows`; points without one are left out.

    The points go to all tasks; each task keeps its least distance a point, and these are reduced.
    """
    numbers = len(schema.numeric)
    held = rows.sparkSession.sparkContext.broadcast(points[_names(schema)].to_numpy(float))

    def run(frames):
        q = held.value
        least = np.full(len(q), np.inf)
        step = max(1, CELLS // max(len(q), 1))
        for frame in frames:
            x = frame.drop_duplicates().to_numpy(float)
            for at in range(0, len(x), step):
                part = x[at : at + step]
                d = np.zeros((len(q), len(part)))
                for k in range(q.shape[1]):
                    d += (q[:, k, None] - part[None, :, k]) ** 2 if k < numbers else 2.0 * (q[:, k, None] != part[None, :, k])
                np.minimum(least, d.min(axis=1), out=least)
        seen = np.flatnonzero(np.isfinite(least))
        yield pd.DataFrame({"at": seen, "d": least[seen]})

    found = rows.mapInPandas(run, "at long, d double").groupBy("at").agg(F.min("d").alias("d"))
    return found.select("at", F.round(F.sqrt("d"), 9).alias("distance"))


def nearest(queries: DataFrame, rows: DataFrame, schema: Schema, most: int = 20_000) -> DataFrame:
    """Adds `distance`: from each query to the nearest row, Euclidean over scaled numbers and one-hot categories.

    A stated set of queries against all rows: the queries' distinct features, at most `most` (more are refused), go to all
    tasks; each task keeps its least distance a query, and these are reduced. Equal rows are met once, wherever they lie:
    private tables have far fewer different rows than rows. Without rows the distance is null.
    """
    columns, names = features(schema), _names(schema)
    asked = queries.select("*", *columns)
    points = asked.select(*names).distinct().limit(most + 1).toPandas()
    if len(points) > most:
        raise ValueError(f"more than {most} different queries")
    table = queries.sparkSession.createDataFrame(points.assign(at=np.arange(len(points))), ", ".join(f"`{n}` double" for n in names) + ", at long")
    met = rows.select(*columns).distinct().repartition(queries.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    told = table.join(_least(points, met, schema), "at", "left").select(*names, "distance")
    return asked.join(F.broadcast(told), names, "left").select(*queries.columns, "distance")  # at most `most` rows


def closer_share(queries: DataFrame, train: DataFrame, holdout: DataFrame, schema: Schema, most: int = 20_000) -> DataFrame:
    """One row (n, share): how many of the queries lie nearer to the training rows than to the held-out ones; ties count half.

    About a half is expected of rows that copy nothing, given two tables of the same size. All queries count: their
    distinct features, with their numbers of rows, are taken in blocks of about `most`, one after another.
    """
    columns, names = features(schema), _names(schema)
    points = queries.select(*columns).groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).persist()
    tables = [df.select(*columns).distinct().persist() for df in (train, holdout)]
    blocks = max(1, -(-points.count() // most))
    n, score = 0, 0.0
    for block in range(blocks):
        part = points.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == block).toPandas()
        near = []
        for table in tables:
            found = _least(part, table, schema).toPandas()
            d = np.full(len(part), np.nan)
            d[found["at"].to_numpy(int)] = found["distance"].to_numpy(float)
            near.append(d)
        told = np.isfinite(near[0]) & np.isfinite(near[1])
        rows = part["_rows"].to_numpy(np.int64)[told]
        n += int(rows.sum())
        score += float((rows * ((near[0] < near[1]) + 0.5 * (near[0] == near[1]))[told]).sum())
    for table in (points, *tables):
        table.unpersist()
    made = queries.sparkSession.createDataFrame([(n, score / n if n else None)], "n long, share double")
    return made.select("n", F.round("share", 9).alias("share"))
