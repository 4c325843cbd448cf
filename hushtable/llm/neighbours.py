"""Approximate nearest neighbours: a balanced partition of a neighbour graph, learned by a small classifier that routes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushtable.llm.common import materialize, portion


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest by inner product of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.15, seed: int = 5) -> np.ndarray:
    """Label the graph's nodes so that few edges are cut and no part exceeds its share by more than the slack.

    Starts from capacity-bounded nearest centres, then moves nodes to the part that most of their neighbours are in,
    largest gain first, while it has room.
    """
    rng = np.random.default_rng(seed)
    room = int(np.ceil(len(x) / parts * slack))
    centres = x[rng.choice(len(x), parts, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(6):
        s = x @ centres.T
        order = np.argsort(-(s.max(1) - np.median(s, 1)), kind="stable")
        ranked = np.argsort(-s, axis=1, kind="stable")
        size = np.zeros(parts, np.int64)
        for i in order:
            own = next(p for p in ranked[i] if size[p] < room)
            label[i] = own
            size[own] += 1
        for p in range(parts):
            if (label == p).any():
                mean = x[label == p].mean(0)
                centres[p] = mean / max(np.linalg.norm(mean), 1e-12)
    both = np.concatenate([near, near[:, :0]], 1)
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), both.shape[1]), label[both.ravel()]), 1)
        np.add.at(votes, (both.ravel(), label[np.repeat(np.arange(len(x)), both.shape[1])]), 1)
        best = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 25, rate: float = 0.003, seed: int = 9):
    """A network with one hidden layer and softmax output, trained by Adam steps on mini-batches."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = (p @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def route(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def exact_top(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """The k nearest candidates of each query, apart from the query itself: (query, candidate, inner product).

    An id with several vectors counts once, with the nearest. A matrix product preselects with a margin for rounding; the sums are then taken dimension by dimension, so that
    equal vectors have equal scores.
    """
    out = []
    many = int(np.unique(c_ids, return_counts=True)[1].max(initial=1))
    for at in range(0, len(q), 256):
        part, ids = q[at : at + 256], q_ids[at : at + 256]
        s = part @ c.T
        s[ids[:, None] == c_ids[None, :]] = -np.inf
        n = min(k * many, s.shape[1])
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        least = least - 1e-9 * (1 + np.abs(least))
        rows, cols = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        exact = np.zeros(len(rows))
        for d in range(c.shape[1]):
            exact += part[rows, d] * c[cols, d]
        order = np.lexsort((c_ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        if many > 1:
            once = ~pd.DataFrame({"q": rows, "c": c_ids[cols]}).duplicated().to_numpy()
            rows, cols, exact = rows[once], cols[once], exact[once]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        out.append(pd.DataFrame({"query_id": ids[rows[keep]], "vec_id": c_ids[cols[keep]], "score": exact[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def fit(sample: np.ndarray, parts: int, copies: int = 1, aim: float = 0.95, k: int = 20) -> tuple[list[np.ndarray], int]:
    """The router, and how many partitions a query must visit for the aimed recall where each row lies in its `copies` likeliest.

    The graph and its partition cover the whole sample; the router learns from four fifths of it, and the visits are
    counted for the other rows and their neighbours.
    """
    x = unit(sample)
    near = graph(x, k)
    label = balanced_parts(x, near[:, :10], parts)
    own = np.arange(len(x)) % 5 > 0
    w = fit_router(x[own], label[own], parts)
    order = np.argsort(-route(x, w), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    asks = np.flatnonzero(~own)
    need = np.sort(rank[asks[:, None, None], order[near[asks], :copies]].min(axis=2).ravel())
    return w, int(min(parts, need[min(len(need) - 1, int(aim * len(need)))] + 1)) if len(need) else parts


def search(vectors: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding", most_sample: int = 6000, rows_a_part: int = 100, most_parts: int = 256, block: int = 4000) -> DataFrame:
    """The k nearest rows by inner product for each row that satisfies the condition `queries`.

    Every usable row is indexed in the two partitions that the router finds likeliest (one, where there are fewer than four),
    and each query visits as many of the likeliest as `fit` says; all its answers come from there. Only a query that finds
    fewer than k rows so visits every partition. There is a partition for every `rows_a_part` rows, `most_parts` at most. Of
    copies of one vector only the k + 1 smallest ids can be among any k nearest, so no others are compared; this limit
    is exact. Partitions that fill beyond `block` rows, and their queries, are cut into blocks. The router is fitted on
    about `most_sample` rows chosen by a hash of their id; these are not compared with anything apart from that.

    Vectors that are null, zero, or hold a null or non-finite component take no part; neither do null ids. Vectors of
    another length are searched among their own kind. An id with several vectors is one candidate, with the nearest of
    them, and asks with the smallest. Returns query_id, rank, vec_id, score.
    """
    usable = vectors.selectExpr(f"`{key}` as id", f"`{vector}` as v", f"({queries}) as asks").where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    found = [search_width(usable.where(F.size("v") == r["n"]), r["count"], r["n"], k, most_sample, rows_a_part, most_parts, block) for r in usable.groupBy(F.size("v").alias("n")).count().collect()]
    schema = f"query_id {vectors.schema[key].dataType.simpleString()}, rank int, vec_id {vectors.schema[key].dataType.simpleString()}, score double"
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], schema)


def search_width(usable: DataFrame, total: int, width: int, k: int, most_sample: int, rows_a_part: int, most_parts: int, block: int) -> DataFrame:
    spark = usable.sparkSession
    name = usable.schema["id"].dataType.simpleString()
    schema = f"query_id {name}, vec_id {name}, score double"
    pairs = usable.select("id", "v").distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = pairs.withColumn("copy", first).where(F.col("copy") <= k + 1).drop("copy")
    asking = usable.where("asks").groupBy("id").agg(F.min("v").alias("v"))

    sample = usable.where(portion("id", 3) < most_sample / total).select("id", "v").toPandas().sort_values("id")
    sample = sample[~sample["v"].map(tuple).duplicated()]
    x = np.array(sample["v"].tolist(), float).reshape(len(sample), width)
    parts = int(min(most_parts, max(1, total // rows_a_part), max(1, len(x) // 20)))
    copies = 2 if parts >= 4 else 1
    model, visit = fit(x, parts, copies) if parts > 1 else (None, 1)
    held = spark.sparkContext.broadcast(model)

    def place(visits):
        def run(frames):
            for frame in frames:
                if not len(frame):
                    continue
                if held.value is None:
                    yield frame.assign(part=0)
                    continue
                logits = route(unit(np.array(frame["v"].tolist(), float)), held.value)
                cells = np.argsort(-logits, axis=1, kind="stable")[:, :visits]
                yield frame.loc[frame.index.repeat(cells.shape[1])].assign(part=cells.ravel().astype(np.int32))

        return run

    kind = usable.schema["v"].dataType.simpleString()
    indexed = candidates.mapInPandas(place(copies), f"id {name}, v {kind}, part int")
    blocks = {r["part"]: max(1, -(-r["count"] // block)) for r in indexed.groupBy("part").count().collect()}
    every = lambda of: F.explode(F.sequence(F.lit(0), number(of).cast("int") - 1))
    deal = lambda of: F.pmod(F.xxhash64("id"), number(of)).cast("int")

    def number(of: dict):
        pairs = [F.lit(x) for p, n in of.items() if n > 1 for x in (p, n)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("part")), F.lit(1)) if pairs else F.lit(1)

    def rerank(asks, has):
        if not len(asks) or not len(has):
            return pd.DataFrame({"query_id": asks["id"].head(0), "vec_id": asks["id"].head(0), "score": pd.Series(dtype=float)})
        q, c = (np.array(f["v"].tolist(), float) for f in (asks, has))
        return exact_top(q, asks["id"].to_numpy(), c, has["id"].to_numpy(), k)

    def visited(queries: DataFrame, visits: int) -> DataFrame:
        routed = queries.mapInPandas(place(visits), f"id {name}, v {kind}, part int")
        asked = {r["part"]: max(1, -(-r["count"] // block)) for r in routed.groupBy("part").count().collect()}
        left = routed.withColumn("qb", deal(asked)).withColumn("cb", every(blocks))
        right = indexed.withColumn("cb", deal(blocks)).withColumn("qb", every(asked))
        found = left.groupBy("part", "qb", "cb").cogroup(right.groupBy("part", "qb", "cb")).applyInPandas(rerank, schema)
        return materialize(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))

    found = visited(asking, visit)
    if visit < parts:
        enough = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k)
        short = materialize(asking.join(enough, "id", "left_anti"))
        if short.take(1):
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(visited(short, parts))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
