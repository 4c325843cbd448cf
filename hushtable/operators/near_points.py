"""The k nearest points of a table for every point asked, exact and without a bound on either side.

Points of the table go to cells around pivots. A point first searches its own cell; the distance found there, or what the
cells' radii promise, rules out all cells that the triangle inequality and the planes between pivots put farther away.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators.closest import _names, features

#: Cells of a block of distances in a task, points of a block of a cell, and pivots at most.
CELLS, BLOCK, PIVOTS = 4_000_000, 20_000, 1024
#: Distances carry rounding errors; a cell is ruled out only if it is farther by so much.
SURE = 2e-9


def squared(q: np.ndarray, x: np.ndarray, numbers: int) -> np.ndarray:
    """Squared distances: numbers as they are, categories (places) 2 apart where they differ, as one-hot vectors are."""
    d = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        d += (q[:, k, None] - x[None, :, k]) ** 2 if k < numbers else 2.0 * (q[:, k, None] != x[None, :, k])
    return d


def _in_steps(q: np.ndarray, x: np.ndarray, numbers: int):
    step = max(1, CELLS // max(len(x), 1))
    for at in range(0, len(q), step):
        yield at, squared(q[at : at + step], x, numbers)


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest of each row, ties to the smaller column, in order."""
    if d.shape[1] > k:
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
    else:
        row, col = np.divmod(np.arange(d.size), d.shape[1])
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _double(names: list[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


def k_nearest(asked: DataFrame, rows: DataFrame, names: list[str], numbers: int, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """For each different point of `asked` its k nearest different points of `rows`: names, rank, distance, near, near_rows.

    Points are the columns `names`, all double and not null: the first `numbers` are numbers, the others places of categories.
    `near` has the neighbour's columns and `near_rows` how many rows lie there; ranks go by distance (9 digits), then `near`. With
    fewer than k points in `rows` a point has as many as there are; without any, none. A cell with more than `block` points
    is searched in blocks, and where more than that ask for a cell, in parts, so no task holds more than one of each.
    """
    base = rows.select(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).persist()
    asked = asked.select(*names).distinct()
    n = base.count()
    held = base.orderBy(F.xxhash64(*names), *names).limit(max(1, min(pivots, math.isqrt(n)))).select(*names).toPandas().to_numpy(float)

    def to_cells(frames):
        for f in frames:
            x = f[names].to_numpy(float)
            cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for at, d in _in_steps(x, held, numbers):
                cell[at : at + len(d)] = d.argmin(axis=1)
                far[at : at + len(d)] = np.sqrt(d.min(axis=1))
            yield f.assign(_cell=cell, _far=far)

    if not n:
        return asked.sparkSession.createDataFrame([], f"{_double(names)}, rank int, distance double, near array<double>, near_rows long")
    celled = base.mapInPandas(to_cells, f"{_double(names)}, _rows long, _cell long, _far double").persist()
    asked = asked.mapInPandas(to_cells, f"{_double(names)}, _cell long, _far double").persist()
    table = celled.groupBy("_cell").agg(F.min("_far").alias("inner"), F.max("_far").alias("outer"), F.count("*").alias("points")).toPandas().sort_values("_cell")
    base.unpersist()
    blocks = dict(zip(table["_cell"].tolist(), (-(-table["points"] // block)).tolist()))
    own = _searched(asked.select(*names, "_cell"), celled, names, numbers, k, blocks, block).persist()
    reach = own.groupBy(*names).agg(F.count("*").alias("_found"), F.max("distance").alias("_reach"))
    near = asked.join(reach, names, "left").select(*names, "_cell", F.when(F.col("_found") >= k, F.col("_reach")).alias("_reach"))
    cells, inner, outer, points = (table[c].to_numpy() for c in ("_cell", "inner", "outer", "points"))
    between = np.sqrt(squared(held[cells], held[cells], numbers))

    def others(frames):
        for f in frames:
            q, home, limit = f[names].to_numpy(float), np.searchsorted(cells, f["_cell"].to_numpy()), f["_reach"].to_numpy(float)
            for at, d in _in_steps(q, held[cells], numbers):
                d, here = np.sqrt(d), home[at : at + len(d)]
                known = (here < len(cells)) & (cells[np.minimum(here, len(cells) - 1)] == f["_cell"].to_numpy()[at : at + len(d)])
                here = np.minimum(here, len(cells) - 1)
                order = np.argsort(d + outer, axis=1)
                enough = (np.cumsum(points[order], axis=1) >= min(k, n)).argmax(axis=1)
                promised = np.take_along_axis(d + outer, order, axis=1)[np.arange(len(d)), enough]
                most = np.fmin(limit[at : at + len(d)], promised)[:, None] + SURE
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - d[np.arange(len(d)), here][:, None] ** 2) / (2 * between[here])
                plane[~known] = 0
                least = np.fmax(np.maximum(d - outer, inner - d), plane)
                visit = least <= most
                visit[np.flatnonzero(known), here[known]] = False
                row, cell = np.nonzero(visit)
                yield f[names].iloc[at : at + len(d)].iloc[row].assign(_cell=cells[cell])

    more = near.mapInPandas(others, f"{_double(names)}, _cell long")
    found = own.unionByName(_searched(more, celled, names, numbers, k, blocks, block))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("distance", "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*names, "rank", "distance", "near", "near_rows")


def _searched(visits: DataFrame, celled: DataFrame, names: list[str], numbers: int, k: int, blocks: dict, block: int) -> DataFrame:
    """The k nearest in each block of the cells that a point visits. How many blocks and parts a cell has comes from counts,
    one row a cell."""
    asks = {r["_cell"]: -(-r["count"] // block) for r in visits.groupBy("_cell").count().collect() if r["_cell"] in blocks}
    spark = celled.sparkSession
    shape = [(c, b, asks.get(c, 1)) for c, b in blocks.items()]
    mixed, keys = F.xxhash64(*names), ["_cell", "_block", "_part"]

    def dealt(df: DataFrame, by: str, over: str, own: str, all_: str) -> DataFrame:
        known = F.broadcast(spark.createDataFrame(shape, "_cell long, _blocks long, _parts long"))
        return df.join(known, "_cell").withColumn(own, F.pmod(mixed, by)).withColumn(all_, F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1))).drop("_blocks", "_parts")

    left, right = dealt(visits, "_parts", "_blocks", "_part", "_block"), dealt(celled, "_blocks", "_parts", "_block", "_part")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(names)
        q, x, count = a[names].to_numpy(float), b[names].to_numpy(float), b["_rows"].to_numpy()
        out = []
        if len(x):
            for at, d in _in_steps(q, x, numbers):
                d = np.round(np.sqrt(d), 9)  # so that what should be equal is, whatever way it was summed up
                row, col = _smallest(d, k)
                out.append(a[names].iloc[at : at + len(d)].iloc[row].assign(distance=d[row, col], near=list(x[col]), near_rows=count[col]))
        return pd.concat(out) if out else pd.DataFrame(columns=[*names, "distance", "near", "near_rows"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, f"{_double(names)}, distance double, near array<double>, near_rows long")


def nearest_rows(queries: DataFrame, rows: DataFrame, schema: Schema, k: int = 1) -> DataFrame:
    """Adds `distances`: from each query to its k nearest rows, ascending, each of several equal rows counted.

    Distances are Euclidean over scaled numbers and one-hot categories. Every query row comes back once, also with the same
    features as others; without rows its list is empty.
    """
    columns, names = features(schema), _names(schema)
    asked = queries.select("*", *columns)
    found = k_nearest(asked, rows.select(*columns), names, len(schema.numeric), k)
    every = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "distance", "near_rows"))), lambda s: F.array_repeat(s["distance"], F.least(s["near_rows"], F.lit(k)).cast("int"))))
    told = found.groupBy(*names).agg(F.slice(every, 1, k).alias("distances"))  # at most k entries each
    return asked.join(told, names, "left").select(*queries.columns, F.coalesce("distances", F.array().cast("array<double>")).alias("distances"))


def covered(asked: DataFrame, rows: DataFrame, schema: Schema, k: int = 5) -> DataFrame:
    """One row (n, share): how many of `asked` lie within the radius of their nearest row, which is how far that row's k-th
    nearest other row lies. Of several nearest points the first by its features counts."""
    columns, names = features(schema), _names(schema)
    asked, rows = asked.select(*columns), rows.select(*columns)
    first = k_nearest(asked, rows, names, len(schema.numeric), 1).select(*names, "distance", "near").persist()
    places = [F.col("near")[i].alias(n) for i, n in enumerate(names)]
    radii = k_nearest(first.select(*places), rows, names, len(schema.numeric), k + 1)
    before = F.sum("near_rows").over(Window.partitionBy(*names).orderBy("rank"))
    radii = radii.withColumn("_upto", before).groupBy(F.array(*names).alias("near")).agg(F.coalesce(F.min(F.when(F.col("_upto") > k, F.col("distance"))), F.max("distance")).alias("radius"))
    told = asked.groupBy(*names).agg(F.count("*").alias("_n")).join(first.join(radii, "near"), names)
    return told.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.round(F.sum(F.when(F.col("distance") <= F.col("radius"), F.col("_n")).otherwise(0)) / F.sum("_n"), 9).alias("share"))
