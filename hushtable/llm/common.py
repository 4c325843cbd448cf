"""Helpers that the operators share: shared storage, bounded samples, word tables and substring hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = np.uint64(0x100000001B3)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and no executor's loss can undo it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Materialised tables of one schema as one: a single scan, however many they are, where a union's plan grows with them."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.written for t in tables])


def forget(*tables: DataFrame | None) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold an Arrow batch to so many rows in this session, unless it is held to fewer: texts are long, and both ends of
    the pipe keep a whole batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def over_texts(docs: DataFrame, names: list[str], text: str, made: str, start, most: int = 2_000_000) -> DataFrame:
    """The columns `names` of every row untouched, and next to them the columns `made` (a schema) from its whole text.

    `start()` is called once a task; what it returns is called with lists of texts of about `most` characters together and
    gives a list or array for each made column. Kept columns never leave Arrow, so ids of any type stay what they are. A
    kept column with the name of a made one is called <name>_input.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(made) if isinstance(made, str) else made
    taken = {f.name for f in fields}
    kept = []
    for name in names:
        new = name
        while new in taken:
            new += "_input"
        taken.add(new)
        kept.append(new)
    picked = docs.select(*[docs[f"`{n}`"].alias(f"_{i}") for i, n in enumerate(names)], docs[f"`{text}`"].alias("_text"))
    schema = T.StructType([T.StructField(k, picked.schema[f"_{i}"].dataType) for i, k in enumerate(kept)] + list(fields))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        work = start()
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(own), 0).to_numpy(zero_copy_only=False)) // most
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    got = work(own.slice(a, b - a).to_pylist())
                    done = [pa.array(x, kind, from_pandas=True) for x, kind in zip(got, kinds)]
                    yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + done, names=schema.names)

    return picked.mapInArrow(run, schema)


def remainder(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id has a null remainder."""
    return F.crc32(F.col(column).cast("string")) % n


def portion(column: str, salt: int = 0):
    """A number from 0 to 1 that depends on an id alone; all null ids get the same one."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by`, chosen by a hash of `key`: a fraction for each value from one count.

    The choice needs no window and no sort; it expects few distinct values of `by`. Where each key has a row or two, the
    size is `most` for each value give or take a few times its root.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = F.when(F.col(by).eqNullSafe(F.lit(value)), portion(key) < most / max(n, 1)).otherwise(keep)
    return df.where(keep)


def word_ids(lists: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words of some word lists, the lists as one array of their numbers, and the length of each list."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    flat = np.fromiter((i for words in lists for i in map(number.__getitem__, words)), np.int64)
    return list(number), flat, np.fromiter(map(len, lists), np.int64, len(lists))


def list_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run has the sum 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def by_length(words: list[str]):
    """Words grouped by length as (row numbers, matrix of code points)."""
    groups = defaultdict(list)
    for row, word in enumerate(words):
        if word:
            groups[len(word)].append(row)
    for length, rows in groups.items():
        points = np.frombuffer("".join(map(words.__getitem__, rows)).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield np.array(rows), points.reshape(len(rows), length)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row, the empty one first."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + points[:, i].astype(np.uint64) + np.uint64(1)
    return out


def substring_hash(prefixes: np.ndarray, start: int, length: int) -> np.ndarray:
    return prefixes[:, start + length] - prefixes[:, start] * np.uint64(pow(int(BASE), length, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Remembered:
    """Values of words, computed for new words in one go and kept up to a bound on their number."""

    def __init__(self, compute, most: int = 300_000):
        self.compute, self.most, self.kept = compute, most, {}

    def __call__(self, words: list) -> list:
        if len(self.kept) > self.most:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        if new:
            self.kept.update(zip(new, self.compute(new)))
        return list(map(self.kept.__getitem__, words))


def slices(frame, column: str = "text", most: int = 2_000_000):
    """Parts of a pandas frame with about `most` characters each, so that working memory has a bound."""
    sizes = frame[column].str.len().fillna(0).to_numpy()
    part = (np.cumsum(sizes) // most).astype(int)
    for k in np.unique(part):
        yield frame[part == k]
