"""Exact components and links of a Jaccard join on word shingles, by index lists skipped in blocks and answers carried over."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushtable.llm.common import forget, materialize, mix, over_texts, shared_dir, small_batches, together, word_ids

#: Slots of the frequency sketch, and the parts in which it travels.
SLOT_BITS = 21
CHUNKS = 32
#: Bits of a set's parity mark, and of the filter of wanted ids.
MARK = 512
FILTER_BITS = 1 << 25
#: In turn t a place meets the places before it in its list that are REACH[t] or more and less than REACH[t + 1] away; the
#: reach goes on growing eightfold until no list is left that is longer.
REACH = (1, 8)
#: Lists with more places than this are cut into blocks of so many places, which are met in pairs by different tasks.
BLOCK = 1024
#: Links that one task hangs on their smallest ids.
LINKS = 200_000


def shingles(texts: list, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes. Words are runs without white space, A-Z in lower case.

    A text with fewer words than `width` has its whole sequence as one shingle; without a word it has none.
    """
    import xxhash

    words, flat, lengths = word_ids([t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts])
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[flat] if words else np.zeros(0, np.uint64)
    n = max(len(own) - width + 1, 0)
    rolled = own[:n].copy()
    for k in range(1, width):
        rolled = mix(rolled) + own[k : k + n]
    rolled = mix(rolled)
    out, ends = [], np.cumsum(lengths)
    for end, length in zip(ends, lengths):
        if length >= width:
            out.append(np.unique(rolled[end - length : end - width + 1]))
        elif length:
            h = np.uint64(length)
            for w in own[end - length : end]:
                h = mix(np.array([h], np.uint64) ^ np.uint64(0xA5A5A5A5))[0] ^ w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many (document, shingle) pairs fall in each of a fixed number of slots: a bounded picture of what is common."""
    small_batches(docs.sparkSession)

    def count(frames):
        from pyspark import TaskContext

        total = np.zeros(1 << SLOT_BITS, np.int64)
        for frame in frames:
            texts, held, size = [], frame["text"].tolist(), 0
            for t in [*held, None]:
                if t is not None:
                    texts.append(t)
                    size += len(t)
                if texts and (size > 1_000_000 or t is None):
                    for s in shingles(texts, width):
                        np.add.at(total, slot_of(s), 1)
                    texts, size = [], 0
        group = TaskContext.get().partitionId() % 64
        for k, part in enumerate(np.split(total, CHUNKS)):
            yield pd.DataFrame({"chunk": [k], "grp": [group], "n": [zlib.compress(part.astype("<u4" if part.max() < 1 << 32 else "<u8").tobytes(), 1)], "wide": [bool(part.max() >= 1 << 32)]})

    def add(frame):
        total = sum(np.frombuffer(zlib.decompress(n), "<u8" if wide else "<u4").astype(np.uint64) for n, wide in zip(frame["n"], frame["wide"]))
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "grp": [0], "n": [zlib.compress(total.astype("<u8").tobytes(), 1)], "wide": [True]})

    kind = "chunk int, grp int, n binary, wide boolean"
    counts = docs.where("text is not null").select("text").mapInPandas(count, kind)
    counts = counts.groupBy("chunk", "grp").applyInPandas(add, kind).groupBy("chunk").applyInPandas(add, kind)
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    size = len(out) // CHUNKS
    for row in counts.collect():
        part = np.frombuffer(zlib.decompress(row["n"]), "<u8")
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.minimum(part, 0xFFFFFFFF)
    return out


def profiles(docs: DataFrame, width: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """Each document's set size, a 128-bit fingerprint of its set, its parity mark, and its rarest shingles.

    The mark has a bit for each of 512 cells: whether an odd number of shingles falls in it. The marks of two sets differ
    in no more cells than the sets differ in shingles, so a mark can rule a link out but never wrongly.

    Two sets that link share one of their first n - ceil(num * n / den) + 1 shingles in any fixed order; here those in the
    sketch's rarest slots come first.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)

    def start():
        order_of = held.value

        def work(texts):
            n, f1, f2, marks, rare = [], [], [], [], []
            for s in shingles(texts, width):
                take = len(s) + (-num * len(s) // den) + 1 if len(s) else 0
                rare.append(s[np.lexsort((s, order_of[slot_of(s)]))[:take]].view(np.int64))
                odd = np.bincount((mix(s) & np.uint64(MARK - 1)).astype(np.int64), minlength=MARK) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).tobytes())
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64).view(np.int64)))
            return n, f1, f2, marks, rare

        return work

    return over_texts(docs, ["id"], "text", "n int, f1 long, f2 long, mark binary, rare array<long>", start, 1_000_000)


def needed(a, b, num: int, den: int):
    """The least common shingles of two sets of these sizes that link: 100 i >= 90 (a + b - i), solved for i."""
    return -(-num * (a + b) // (den + num))


def index_lists(reps: DataFrame, block: int) -> DataFrame:
    """The places of all index lists that hold at least two sets, each list in order of size and position.

    A row is (token, id, np, place, m): size and position as np = n * 2^32 + pos, the place in the list, and the
    list's length. Lists that a sample of the ids finds long are numbered over sorted partitions, so that none is put
    whole in a task; the sample decides how a list is numbered, not what is in it.
    """
    posted = reps.where("id is not null and n > 0").select("id", "n", F.posexplode("rare").alias("pos", "token"))
    posted = posted.select("token", "id", (F.col("n").cast("long") * (1 << 32) + F.col("pos")).alias("np"))
    many = posted.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).groupBy("token").count().where(F.col("count") > block // 8)
    many = materialize(many.orderBy(F.desc("count"), "token").select("token").limit(1_000_000))  # 8 MB at most
    hot = F.broadcast(many)
    by = Window.partitionBy("token").orderBy("np", "id")
    lists = posted.join(hot, "token", "left_anti").repartition("token")
    lists = lists.withColumn("place", F.row_number().over(by).cast("long") - 1).withColumn("m", F.count("*").over(Window.partitionBy("token")))
    lists = lists.where("m > 1").select("token", "id", "np", "place", "m")
    if not many.isEmpty():
        long = posted.join(hot, "token", "left_semi").repartitionByRange("token", "np", "id").sortWithinPartitions("token", "np", "id")
        long = materialize(long.withColumn("at", F.monotonically_increasing_id()))
        parts = long.groupBy("token", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("start"), F.count("*").alias("rows"))
        before = Window.partitionBy("token").orderBy("part")
        shift = parts.select("token", "part", (F.sum("rows").over(before) - F.col("rows") - F.col("start")).alias("shift"), F.sum("rows").over(Window.partitionBy("token")).alias("m"))
        long = long.withColumn("part", F.shiftright("at", 33)).join(shift, ["token", "part"])
        lists = lists.union(long.where("m > 1").select("token", "id", "np", (F.col("at") + F.col("shift")).alias("place"), "m"))
    return materialize(lists)


def place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def filter_of(ids: DataFrame) -> dict[int, bytes]:
    """A filter of fixed size that all of these ids pass, and few others."""
    at = ids.select(place("id").alias("p"))
    rows = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    return {r["k"]: bytes(r["bits"]) for r in rows}


def texts_of(ids: DataFrame, docs: DataFrame, unique: bool, kind: str, exact: bool = False) -> DataFrame:
    """The texts of some documents, packed small: a filter of fixed size picks them while they are read.

    What the filter lets through beyond them finds no partner; `exact` leaves it out, which needs distinct ids. Texts, unlike
    hashes, compress, so they move instead of sets.
    """
    held = docs.sparkSession.sparkContext.broadcast(filter_of(ids))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for k, part in held.value.items():
            bits[(k - 1) * 4096 : (k - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False) - 1
            mine = batch.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in mine.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(packed, pa.binary())], names=["id", "t"])

    found = docs.where("id is not null and text is not null").select("id", "text", place("id").alias("p")).mapInArrow(run, f"id {kind}, t binary")
    found = found.join(ids, "id", "left_semi") if exact else found
    out = materialize(found if unique else found.distinct())
    held.destroy()  # else each turn's filter stays with the driver
    return out


def verify(pairs: DataFrame, texts: DataFrame, unique: bool, width: int, num: int, den: int, kind: str) -> DataFrame:
    """The exact difference of the sets of each pair (a, b) of documents, and whether they link."""

    def compare(frames):
        for whole in frames:
            for at in range(0, len(whole), 100):
                frame = whole.iloc[at : at + 100]
                both = list(set(frame["ta"]) | set(frame["tb"]))
                sets = dict(zip(both, shingles([zlib.decompress(t).decode("utf-8", "surrogatepass") for t in both], width)))
                out = []
                for a, b in zip(map(sets.__getitem__, frame["ta"]), map(sets.__getitem__, frame["tb"])):
                    i = len(np.intersect1d(a, b, assume_unique=True))
                    out.append((len(a) + len(b) - 2 * i, i > 0 and den * i >= num * (len(a) + len(b) - i)))
                done = pd.DataFrame(out, columns=["far", "linked"])
                yield pd.concat([frame[["a", "b"]].reset_index(drop=True), done], axis=1)

    left = texts.withColumnRenamed("id", "b").withColumnRenamed("t", "tb")
    right = texts.withColumnRenamed("id", "a").withColumnRenamed("t", "ta")
    done = pairs.join(left, "b").join(right, "a").mapInPandas(compare, f"a {kind}, b {kind}, far long, linked boolean")
    # an id with several texts links if one of them does; its distances then bound nothing
    return done if unique else done.groupBy("a", "b").agg(F.lit(None).cast("long").alias("far"), F.max("linked").alias("linked"))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of the numbers below n reaches by the links (a, b)."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (least[least] != least).any():
            least = least[least]


def stars(edges: DataFrame, parts: int, most: int) -> DataFrame:
    """The same components with fewer links: what a task reads is hung on its smallest ids, about `most` links at a time."""

    def hang(links):
        ids, codes = np.unique(pd.concat([links["u"], links["v"]]).to_numpy(), return_inverse=True)
        least = roots(codes[: len(links)], codes[len(links) :], len(ids))
        moved = np.flatnonzero(least != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[moved], "v": ids[least[moved]]})

    def run(frames):
        held, count = [], 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count > most:
                held = [hang(pd.concat(held))]
                count = len(held[0])
                if count > most // 2:
                    yield held[0]
                    held, count = [], 0
        if held:
            yield hang(pd.concat(held))

    return edges.coalesce(parts).mapInPandas(run, edges.schema)


def components(edges: DataFrame, most: int = LINKS) -> DataFrame:
    """Smallest id that each id reaches: neighbours are hung on the smallest one, in turns, until nothing changes.

    `edges` has columns a, b. Each turn first hangs what single tasks hold, `most` links each or about that, then the
    neighbours that lie in different tasks; where one task holds all links, its answer is the whole. Each turn is written
    to the shared folder; no links come to the driver.
    """
    now = materialize(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v"))
    size = None
    while True:
        parts = now.count() // most + 1
        hung = materialize(stars(now, parts, 2 * most))
        forget(now)
        if parts == 1:
            return hung.selectExpr("u as id", "v as component")
        hung, once = materialize(hung.distinct()), hung
        both = hung.union(hung.selectExpr("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m"))
        large = materialize(both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m"))
        now = materialize(small.distinct())
        forget(once, hung, least, large)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == size:
            return now.selectExpr("u as id", "v as component")
        size = after


def cells_of(rows: DataFrame, lists: DataFrame, longest: int, lo: int, hi: int, block: int, num: int, den: int) -> DataFrame:
    """The rows of each pair of blocks of a list that can hold pairs of places from lo to hi apart: (token, cell, far).

    A list of one block is its own only cell. Longer ones are read in pairs of blocks, so that a hot list is met by many
    tasks. A pair of blocks is skipped where the largest set of the one is too small for the smallest of the other, or
    where the positions of the one leave too few shingles in common.

    What is told of the blocks and which of them meet is written first: these tables are small, and inside the plan of the
    pairs their four copies were most of what the driver held of it.
    """
    number = F.floor(F.col("place") / block).alias("block")
    columns = ["token", "cell", "apart", "block", *[c for c in rows.columns if c != "token"]]
    short = rows.where(F.col("m") <= block).select("*", number, F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("apart")).select(*columns)
    if longest <= block:
        return short
    cut = lists.where(F.col("m") > block).withColumn("block", number)
    n, left = F.shiftright("np", 32), F.shiftright("np", 32) - F.col("np").bitwiseAND(F.lit((1 << 32) - 1))
    told = materialize(cut.groupBy("token", "block").agg(F.min(n).alias("small"), F.max(n).alias("large"), F.max(left).alias("left")))
    steps = F.sequence(F.lit(max(0, lo // block - 1)).cast("long"), F.least(F.lit(-(-hi // block)), F.col("block")))
    pairs = told.where(F.col("block") >= max(0, lo // block - 1)).select("token", "block", "small", "left", F.explode(steps).alias("apart"))
    pairs = pairs.withColumn("other", F.col("block") - F.col("apart"))
    before = told.select("token", F.col("block").alias("other"), F.col("small").alias("small_o"), F.col("large").alias("large_o"), F.col("left").alias("left_o"))
    pairs = pairs.join(before, ["token", "other"])
    pairs = pairs.where(F.col("large_o") * den >= F.col("small") * num)  # sizes
    pairs = pairs.where(F.least("left", "left_o") * (den + num) >= F.lit(num) * (F.col("small") + F.col("small_o")))  # positions
    key = (F.col("block") * F.lit(1 << 20) + F.col("apart")).alias("cell")
    ends = F.when(F.col("apart") > 0, F.array("block", "other")).otherwise(F.array("block"))
    met = materialize(pairs.select("token", key, "apart", F.explode(ends).alias("block")))
    forget(told)
    return short.union(rows.where(F.col("m") > block).withColumn("block", number).join(met, ["token", "block"]).select(*columns))


def runs(frames):
    """Frames sorted by token and cell, cut so that no cell's rows are in two."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        token, cell = frame["token"].to_numpy(), frame["cell"].to_numpy()
        same = (token == token[-1]) & (cell == cell[-1])
        last = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = frame.iloc[last:]
        if last:
            yield frame.iloc[:last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def owned(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Places with the component `own` of their sets, so far as it is known."""
    if labels is None:
        return lists.withColumn("own", F.col("id"))
    return lists.join(labels, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component")


def mixed(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists whose places belong to several components; no other can close a component any more."""
    if labels is None:
        return lists
    tokens = owned(lists.select("token", "id"), labels).groupBy("token").agg(F.min("own").alias("x"), F.max("own").alias("y"))
    return lists.join(tokens.where("x <> y").select("token"), "token", "left_semi")


def open_pairs(lists: DataFrame, longest: int, marks: DataFrame, labels: DataFrame | None, answers: DataFrame | None, lo: int, hi: int, best: bool, block: int, num: int, den: int, kind: str) -> DataFrame:
    """Pairs of places lo to hi apart in a list which the answers so far leave open: (a, b, y, differ, sure).

    Skipped are: pairs whose components (by `labels`) are one, sizes that can't link, with all that is
    before them in the list, positions that leave too few common shingles, marks that differ in too many cells, and pairs
    whose known distances from one set answered before (`lead`) differ by more than a link allows, as the difference of
    sets is a metric. Where both distances add up to no more than a link allows, the link is `sure`, and carried over from
    the lead's answers without looking at the sets. With `best` only each set's likeliest pair is returned, and only a quarter
    of the lists is looked at: similar sets share many, and what is missed here is left to the turns that look at all.
    """
    rows = owned((lists.where("token % 4 = 0") if best else lists).join(marks, "id"), labels)
    if answers is not None:
        near = answers.where("linked and far is not null").groupBy(F.col("b").alias("id")).agg(F.min(F.struct(F.col("a").alias("lead"), "far")).alias("l")).select("id", "l.*")
        rows = rows.join(near, "id", "left").withColumn("lead", F.coalesce("lead", "id")).withColumn("far", F.coalesce("far", F.lit(0)))
    else:
        rows = rows.withColumn("lead", F.col("id")).withColumn("far", F.lit(0).cast("long"))

    def run(frames):
        for frame in runs(frames):
            token, cell, apart, block_of, ids, own, lead, far = (frame[c].to_numpy() for c in ("token", "cell", "apart", "block", "id", "own", "lead", "far"))
            at, size = frame["place"].to_numpy(), frame["np"].to_numpy()
            n, left = size >> 32, (size >> 32) - (size & 0xFFFFFFFF)
            mark = np.frombuffer(b"".join(frame["mark"]), np.uint64).reshape(len(frame), MARK // 64)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            number = np.arange(len(token)) - first
            alive = np.arange(len(token))
            held, count, chosen = [], 0, {}
            step = lo if not (apart > 1).any() else 1
            while len(alive):
                alive = alive[number[alive] >= step]
                y, x = alive, alive - step
                reach = at[y] - at[x]
                big = den * n[x] >= num * n[y]  # all places further ahead are smaller still
                alive = alive[big & (reach + 1 < hi)]
                fits = big & (reach >= lo) & (reach < hi) & (own[y] != own[x]) & ((apart[y] == 0) | (block_of[y] != block_of[x]))
                y, x = y[fits], x[fits]
                least = needed(n[y], n[x], num, den)
                most = n[y] + n[x] - 2 * least
                fits = (np.minimum(left[y], left[x]) >= least) & ~((lead[y] == lead[x]) & (np.abs(far[y] - far[x]) > most))
                y, x, most = y[fits], x[fits], most[fits]
                differ = np.bitwise_count(mark[y] ^ mark[x]).sum(axis=1, dtype=np.int64)
                fits = differ <= most
                y, x, most, differ = y[fits], x[fits], most[fits], differ[fits]
                if len(y):
                    sure = (lead[y] == lead[x]) & (far[y] + far[x] <= most)
                    a, b = np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x])
                    held.append(pd.DataFrame({"a": a, "b": b, "y": ids[y], "differ": differ, "sure": sure}))
                    count += len(y)
                    if count > 100_000:
                        yield pd.concat(held)
                        held, count = [], 0
                step += 1
            if held:
                out = pd.concat(held)
                yield out.sort_values(["y", "differ", "a", "b"], kind="stable").drop_duplicates("y") if best else out

    rows = cells_of(rows, lists, longest, lo, hi, block, num, den).repartition("token", "cell").sortWithinPartitions("token", "cell", "place")
    return rows.mapInPandas(run, f"a {kind}, b {kind}, y {kind}, differ long, sure boolean")


def search(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, every: bool, block: int):
    """What join and links share: (profiles, representatives, component labels, answers)."""
    if not docs.schema[key].dataType.simpleString().startswith(("string", "int", "bigint", "smallint", "tinyint")):
        raise ValueError(f"{key} must be a string or an integer")
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    told = materialize(profiles(base, width, num, den, sketch(base, width)))
    classes = ["f1", "f2", "n"]
    reps = materialize(told.where("n > 0").groupBy(*classes).agg(F.min("id").alias("id"), F.first("rare").alias("rare"), F.first("mark").alias("mark")))
    lists = index_lists(reps, block)
    unique = told.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    labels = answers = None
    texts, answered = [], []
    if not unique:  # rows that share an id tie their classes together
        shared = told.where("n > 0").join(reps.select(*classes, F.col("id").alias("rep")), classes).where("id <> rep").selectExpr("rep as a", "id as b")
        labels = components(shared)
    reach, best = list(REACH), True
    while True:
        lo, hi = reach[-2:]
        longest = lists.agg(F.max("m")).first()[0]
        if longest is None or longest <= lo and not best:
            break
        found = open_pairs(lists, longest, reps.select("id", "mark"), None if every else labels, answers, lo, hi, best, block, num, den, kind)
        if best:  # each set's likeliest partner over all lists: most components close on these alone
            found = found.groupBy("y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b", F.lit(False).alias("sure")).distinct()
        else:
            found = found.groupBy("a", "b").agg(F.max("sure").alias("sure")).join(answers.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(found)
        if best or not pairs.isEmpty():
            asked = pairs.where("not sure").select("a", "b")
            ends = asked.select(F.col("a").alias("id")).union(asked.select("b"))
            if not texts:
                texts.append(texts_of(ends, base, unique, kind))
            else:
                wanted = materialize(ends.distinct().join(together(texts).select("id"), "id", "left_anti"))
                if not wanted.isEmpty():
                    texts.append(texts_of(wanted, base, unique, kind, exact=True))
                forget(wanted)
            known = together(texts) if best else together(texts).join(ends.distinct(), "id", "left_semi")
            done = verify(asked, known, unique, width, num, den, kind)
            done = materialize(done.union(pairs.where("sure").select("a", "b", F.lit(None).cast("long"), F.lit(True))))
            answered.append(done)
            answers = together(answered)
            fresh = done.where("linked").select("a", "b")
            if not every and not fresh.isEmpty():
                labels = components(fresh if labels is None else fresh.union(labels.selectExpr("id as a", "component as b")))
        if not best:
            reach.append(reach[-1] * 8)
            rest = materialize(mixed(lists.where(F.col("m") > reach[-2]), None if every else labels))
            forget(lists)
            lists = rest
        best = False
    return told, reps, labels, answers, unique


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of at least num/den: exact, none is lost.

    Equal sets form one class, whose smallest id stands for it. Index lists over the classes' rarest shingles give, in
    turns of growing reach, pairs that may link; these are verified on whole sets, and what their answers imply narrows
    the next turn down, until no pair of different components is left open. Pairs inside a component aren't looked at:
    `links` gives them all.

    Ids are strings or integers. A text that is null or has no word has an empty set and links with nothing. Rows that
    share an id are one document whose links are those of all its texts. Rows with a null id get a component only
    through equal texts. Returns key, n_shingles, component_id.
    """
    kind = docs.schema[key].dataType.simpleString()
    told, reps, labels, _, unique = search(docs, key, text, width, num, den, False, block)
    classes = ["f1", "f2", "n"]
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    named = materialize(reps.select(*classes, F.col("id").alias("rep")).join(labels, F.col("rep") == F.col("id"), "left").select(*classes, F.coalesce("component", "rep").alias("component")))
    out = told.select("id", *classes).join(named, classes, "left")
    if not unique:  # an empty text of an id with others
        out = out.join(labels.select("id", F.col("component").alias("tied")), "id", "left").withColumn("component", F.coalesce("component", "tied"))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who is in which class: (a, b) of representatives, and (key, class_id, n_links).

    n_links counts the other documents that a document links with, copies of its own text included. Unlike `join` this
    also answers pairs inside a component, so a group of n texts that all link gives n * (n - 1) / 2 rows. A document
    without a word is in no class and has no link. Ids must not repeat.
    """
    told, reps, _, answers, unique = search(docs, key, text, width, num, den, True, block)
    if not unique:
        raise ValueError(f"{key} repeats")
    classes = ["f1", "f2", "n"]
    found = answers.where("linked").select("a", "b")
    members = told.where("n > 0").groupBy(*classes).count().join(reps.select(*classes, F.col("id").alias("class_id")), classes)
    both = found.select("a", "b").union(found.select("b", "a"))
    others = both.join(members.select(F.col("class_id").alias("b"), "count"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("count").alias("more"))
    members = members.join(others, "class_id", "left").select(*classes, "class_id", (F.col("count") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = told.select("id", *classes).join(members, classes, "left")
    return found, out.select(F.col("id").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
