"""Rows from a generator that is asked for exact counts: what is still owed decides what the next calls ask for.

Two streams hand files to each other in one folder. `requests` holds calls with their counts; the answering stream sends
them to a generator and writes `answers`; the planning stream reads these, keeps for each quota what it has got, and
writes the next requests. Both keep their place in checkpoints, so a run that was cut off goes on where it stopped: no
answered call is asked again and no row is lost or counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from hushtable.functions.bins import Schema, number, selection_bin, text
from hushtable.operators.audit import band_coverage
from hushtable.operators.stage import Release
from hushtable.sources.generated import parse_generated

#: Of each column that cells are conditioned on, released cells must name so much of the released mass.
COVERAGE = 0.9
REQUESTS = "key string, call long, n long, positives long, quotas string, reason string"
ANSWERS = "key string, call long, n long, text string"
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_out(weights, n: int, rng) -> np.ndarray:
    """Whole numbers in proportion to weights that add up to n: largest remainders first, ties at random."""
    weights = np.asarray(weights, float)
    exact = (weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))) * n
    out = np.floor(exact + 1e-9).astype(int)
    order = np.lexsort((rng.random(len(out)), -np.round(exact - out, 9)))
    out[order[: n - out.sum()]] += 1
    return out


def split_rows(rows: int, positives: int, per_call: int) -> list[tuple[int, int]]:
    """Calls of at most `per_call` rows, with positives in proportion, that add up to both numbers."""
    ends = [*range(per_call, rows, per_call), rows] if rows else []
    upto = [(2 * e * positives + rows) // (2 * rows) for e in ends]
    return [(e - a, p - b) for e, a, p, b in zip(ends, [0, *ends], upto, [0, *upto])]


def split_counts(counts, sizes: list[int], rng) -> list[np.ndarray]:
    """Counts by bin dealt to calls of given sizes: each call's add up to its size, all calls' to the counts.

    A bin's rows lie at even steps from 0 to 1, and calls take what comes next, so that each gets about its share.
    """
    counts = np.asarray(counts, int)
    bins = np.repeat(np.arange(len(counts)), counts)
    steps = np.concatenate([(np.arange(c) + rng.random()) / c for c in counts if c] or [np.zeros(0)])
    laid = bins[np.argsort(steps, kind="stable")]
    return [np.bincount(x, minlength=len(counts)) for x in np.split(laid, np.cumsum(sizes)[:-1])] if sizes else []


def quota_columns(schema: Schema) -> list[str]:
    return [*schema.numeric, *schema.categorical]


def _parts(target: dict, most: int, rng) -> list[dict]:
    """A quota in parts of at most `most` rows that add up to it, so that a hot cohort is no single state."""
    sizes = split_rows(target["n"], target["positives"], most)
    out = [{"n": n, "positives": p, "classes": {}} for n, p in sizes]
    for label, columns in target["classes"].items():
        own = [p if label == "1" else n - p for n, p in sizes]
        for c, counts in columns.items():
            for part, dealt in zip(out, split_counts(counts, own, rng)):
                part["classes"].setdefault(label, {})[c] = dealt.tolist()
    return out


def _keyed(targets: dict[str, dict], most: int, rng) -> dict[str, dict]:
    return {f"{key}#{i}": part for key, target in targets.items() if target["n"] for i, part in enumerate(_parts(target, most, rng))}


def cohort_quotas(release: Release, schema: Schema, n: int, seed: int = 0, most: int = 100_000) -> dict[str, dict]:
    """What each cohort owes of n rows: rows, positives, and rows of each class by bin of every column, from the release alone."""
    rng = np.random.default_rng(seed)
    shares = {k: dict(zip(part["bin"], part["share"])) for k, part in release.marginals.groupby(["cohort", "positive", "col"])}
    targets = {}
    for cohort, share, rows in zip(release.cohorts["cohort"], release.cohorts["positive_share"], shared_out(release.cohorts["size"], n, rng).tolist()):
        positives = int(shared_out([share, 1 - share], rows, rng)[0])
        classes = {label: {c: shared_out([shares[cohort, label == "1", c].get(b, 0.0) for b in schema.bins(c)], m, rng).tolist() for c in quota_columns(schema)} for label, m in (("1", positives), ("0", rows - positives))}
        targets[str(cohort)] = {"n": rows, "positives": positives, "classes": classes}
    return _keyed(targets, most, rng)


def cell_quotas(spark: SparkSession, release: Release, schema: Schema, level: int, n: int, seed: int = 0, most: int = 100_000, uncovered: bool = False) -> dict[str, dict]:
    """What each released cell of a level owes of n rows, in proportion to its support; positives are its rate times its rows,
    a fraction rounded at random. Columns that the cell doesn't name follow the mixture of all cohorts, by class.

    Refused where released cells name less than COVERAGE of a column's released mass: the rest would be missing from the
    rows without any measure showing it. `uncovered` allows it.
    """
    rng = np.random.default_rng(seed)
    cells = release.cells[release.cells["level"] == level].sort_values("cell")
    if not len(cells):
        raise ValueError("the release has no cell of this level")
    size = dict(zip(release.cohorts["cohort"], release.cohorts["size"].astype(float)))
    positive = dict(zip(release.cohorts["cohort"], release.cohorts["positive_share"].astype(float)))
    weight = [size[a] * (positive[a] if p else 1 - positive[a]) for a, p in zip(release.marginals["cohort"], release.marginals["positive"])]
    mixed = release.marginals.assign(mass=np.array(weight) * release.marginals["share"])
    rows = mixed.rename(columns={"mass": "size"}).assign(share=1.0)[["cohort", "size", "col", "bin", "share"]]
    low = band_coverage(spark.createDataFrame(rows), spark.createDataFrame(cells[["cell"]]), schema).where(f"covered < {COVERAGE}").collect()
    if low and not uncovered:
        raise ValueError("released cells leave out much of: " + ", ".join(f"{r['col']} ({r['covered']:.0%} named)" for r in sorted(low)))
    masses = mixed.groupby(["positive", "col", "bin"])["mass"].sum().to_dict()
    targets = {}
    for cell, rate, k in zip(cells["cell"], cells["rate"], shared_out(cells["support"], n, rng).tolist()):
        named = set(cell.split(" & "))
        positives = int(np.floor(rate * k + rng.random()))
        classes: dict = {}
        for label, m in (("1", min(positives, k)), ("0", k - min(positives, k))):
            classes[label] = {}
            for c in quota_columns(schema):
                here = [part in named for part in schema.cells(c)]
                shares = [float(x) for x in here] if any(here) else [masses.get((label == "1", c, b), 0.0) for b in schema.bins(c)]
                classes[label][c] = shared_out(shares, m, rng).tolist()
        targets[cell] = {"n": k, "positives": min(positives, k), "classes": classes}
    return _keyed(targets, most, rng)


def next_calls(target: dict, done: dict, per_call: int, rng) -> list[dict]:
    """Calls for all that is still owed: (n, positives, classes), each exact; together they ask for every missing row."""
    rows = max(target["n"] - done["n"], 0)
    positives = min(max(target["positives"] - done["positives"], 0), rows)
    sizes = split_rows(rows, positives, per_call)
    out = [{"n": n, "positives": p, "classes": {"1": {}, "0": {}}} for n, p in sizes]
    for label, m in (("1", positives), ("0", rows - positives)):
        own = [p if label == "1" else n - p for n, p in sizes]
        for c, counts in target["classes"][label].items():
            left = np.maximum(np.array(counts) - np.array(done["classes"][label][c]), 0)
            left = left if left.sum() == m else shared_out(left if left.sum() else counts, m, rng)
            for call, dealt in zip(out, split_counts(left, own, rng)):
                call["classes"][label][c] = dealt.tolist()
    return out


class Planner(StatefulProcessor):
    """The state of one quota: its target, what has come, calls that are open, and when to stop.

    A quota is met when it has its rows. It is given up after `tries` times the calls it would take, and once `after`
    calls have brought less than `least` of the rows they asked for.
    """

    def __init__(self, schema: Schema, per_call: int, tries: int, after: int, least: float, seed: int):
        self.names, self.widths = quota_columns(schema), [len(schema.bins(c)) for c in quota_columns(schema)]
        self.per_call, self.tries, self.after, self.least, self.seed = per_call, tries, after, least, seed

    def init(self, handle) -> None:
        self.kept = handle.getValueState("quota", "doc string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        frames = list(rows)
        if state is None:
            first = next(t for f in frames for t in f.loc[f["call"] == 0, "text"])
            none = {label: {c: [0] * w for c, w in zip(self.names, self.widths)} for label in ("1", "0")}
            state = {"target": json.loads(first), "done": {"n": 0, "positives": 0, "classes": none}, "calls": 0, "open": 0, "asked": 0, "stopped": False}
        done = state["done"]
        for f in frames:
            state["open"] -= int((f["is_call"] & (f["call"] > 0)).sum())
            f = f[~f["is_call"]]
            done["n"] += len(f)
            done["positives"] += int(f["positive"].sum())
            for label in ("1", "0"):
                own = f[f["positive"] == (label == "1")]
                for i, (c, w) in enumerate(zip(self.names, self.widths)):
                    at = own[f"bin_{i}"].dropna().astype(int)
                    done["classes"][label][c] = (np.array(done["classes"][label][c]) + np.bincount(at, minlength=w)[:w]).tolist()
        out = []
        if state["open"] == 0 and not state["stopped"]:
            target, reason = state["target"], None
            if done["n"] >= target["n"]:
                reason = "met"
            elif state["calls"] >= self.after and done["n"] < self.least * state["asked"]:
                reason = "low yield"
            elif state["calls"] >= self.tries * (target["n"] // self.per_call + 1):
                reason = "out of tries"
            if reason:
                state["stopped"] = True
                out.append((key[0], state["calls"], 0, 0, json.dumps({"n": done["n"], "of": target["n"]}), reason))
            else:
                name = int.from_bytes(key[0].encode()[-6:], "big")
                for call in next_calls(target, done, self.per_call, np.random.default_rng([self.seed, name, state["calls"]])):
                    state["calls"], state["open"], state["asked"] = state["calls"] + 1, state["open"] + 1, state["asked"] + call["n"]
                    out.append((key[0], state["calls"], call["n"], call["positives"], json.dumps(call["classes"]), None))
        self.kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["key", "call", "n", "positives", "quotas", "reason"])

    def close(self) -> None:
        pass


def exact_mock(schema: Schema, seed: int = 0, failing: float = 0.0, dropping: float = 0.0) -> Callable[[pd.DataFrame], list[str]]:
    """A generator that meets the counts of each call, columns independent of each other given the class, rows shuffled.

    A share `failing` of calls answers with nothing usable, and a share `dropping` of rows is left out. What a call gets
    depends on seed, key and call alone.
    """
    names = quota_columns(schema)

    def value(c: str, at: int, rng) -> str:
        if c not in schema.numeric:
            return schema.categorical[c][at]
        low, high = (float(x) for x in schema.numeric[c][at : at + 2])
        if all(float(e).is_integer() for e in schema.numeric[c]):
            return str(int(rng.integers(int(low), int(high))))
        return repr(min(low + rng.random() * (high - low), float(np.nextafter(high, low))))

    def answer(requests: pd.DataFrame) -> list[str]:
        out = []
        for key, call, quotas in zip(requests["key"], requests["call"], requests["quotas"]):
            rng = np.random.default_rng([seed, call, *key.encode()])
            if rng.random() < failing:
                out.append("I can't do that.")
                continue
            lines = []
            for label, name in (("1", schema.positive), ("0", schema.negative)):
                columns = json.loads(quotas)[label]
                n = sum(columns[names[0]])
                laid = [rng.permutation(np.repeat(np.arange(len(columns[c])), columns[c])) for c in names]
                lines += [",".join([*(value(c, int(x[i]), rng) for c, x in zip(names, laid)), name]) for i in range(n)]
            lines = [lines[i] for i in rng.permutation(len(lines)) if not dropping or rng.random() >= dropping]
            out.append("\n".join([",".join([*names, schema.target]), *lines]))
        return out

    return answer


def _answered(requests: DataFrame, answer: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "call": f["call"], "n": f["n"], "text": answer(f)})

    return requests.where("reason is null").select("key", "call", "n", "quotas").mapInPandas(run, ANSWERS)


def _counted(answers: DataFrame, schema: Schema) -> DataFrame:
    """A row for each call, and one for each row that was read from it, with its class and bins."""
    binned = [(selection_bin(number(c), schema.numeric[c]) if c in schema.numeric else F.array_position(F.array(*[F.lit(v) for v in schema.bins(c)]), text(c)).cast("int") - 1).alias(f"bin_{i}") for i, c in enumerate(quota_columns(schema))]
    nothing = [F.lit(None).cast("int").alias(f"bin_{i}") for i in range(len(binned))]
    calls = answers.select("key", "call", F.lit(True).alias("is_call"), F.when(F.col("call") == 0, F.col("text")).alias("text"), F.lit(False).alias("positive"), *nothing)
    rows = _rows(answers, schema).select("key", "call", F.lit(False).alias("is_call"), F.lit(None).cast("string").alias("text"), (text(schema.target) == schema.positive).alias("positive"), *binned)
    return calls.unionByName(rows)


def _rows(answers: DataFrame, schema: Schema) -> DataFrame:
    named = answers.where("call > 0").withColumn("_call", F.concat_ws(" ", "call", "key"))
    rows = parse_generated(named, schema, key="_call")
    return rows.select(F.expr("substring(_call, instr(_call, ' ') + 1)").alias("key"), F.substring_index("_call", " ", 1).cast("long").alias("call"), *[c for c in rows.columns if c != "_call"])


def generate(spark: SparkSession, quotas: dict[str, dict], schema: Schema, folder: str, answer: Callable[[pd.DataFrame], list[str]], per_call: int = 25, tries: int = 3, after: int = 8, least: float = 0.2, most_calls: int | None = None, seed: int = 0) -> DataFrame:
    """Rows (key, call, columns) of all answered calls, after asking until every quota is met or given up.

    `folder` is shared storage; calling again with the same one goes on with an unfinished run, and only reads a finished
    one. Calls go out in rounds: each round asks for all that is still owed. With `most_calls` no round begins once so many
    calls have been answered; the rows so far are kept. `status` tells how quotas ended.
    """
    at = lambda name: f"{folder.rstrip('/')}/{name}"
    if not _exists(spark, at("start/_SUCCESS")):  # what a run was cut off in writing is written anew
        spark.createDataFrame([(k, 0, t["n"], json.dumps(t)) for k, t in sorted(quotas.items())], ANSWERS).write.mode("overwrite").parquet(at("start"))
    _folder(spark, at("answers"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    try:
        while True:
            start, answers = (spark.readStream.schema(ANSWERS).parquet(at(name)) for name in ("start", "answers"))
            planner = Planner(schema, per_call, tries, after, least, seed)
            planned = _counted(start.unionByName(answers), schema).groupBy("key").transformWithStateInPandas(planner, REQUESTS, "Append", "None")
            _run(planned, at("requests"), at("_planned"))
            if most_calls is not None and spark.read.schema(ANSWERS).parquet(at("answers")).count() >= most_calls:
                break
            if not _run(_answered(spark.readStream.schema(REQUESTS).parquet(at("requests")), answer), at("answers"), at("_answered")):
                break
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return _rows(spark.read.schema(ANSWERS).parquet(at("answers")), schema)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """How the quotas of a run ended: (key, calls, reason, rows, of)."""
    ended = spark.read.schema(REQUESTS).parquet(f"{folder.rstrip('/')}/requests").where("reason is not null")
    return ended.select("key", F.col("call").alias("calls"), "reason", F.get_json_object("quotas", "$.n").cast("long").alias("rows"), F.get_json_object("quotas", "$.of").cast("long").alias("of"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    p, files = _file_system(spark, path)
    return files.exists(p)


def _folder(spark: SparkSession, path: str) -> None:
    p, files = _file_system(spark, path)
    files.mkdirs(p)


def _run(df: DataFrame, path: str, checkpoint: str) -> int:
    """All that is there goes through a stream into a folder; how many rows came in."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
