"""Phrases whose words belong together: adjacent frequent pairs get names, level by level, each from the names before.

A text is never taken apart into rows. Tasks keep blocks of it as arrays of names. On each level a block deals its distinct
pairs, packed, over parts by a hash; a part adds up the counts of all blocks, names the frequent pairs and packs the names
back to the blocks, where they take the pairs' places. A phrase's name points to the names of its first and its last words
but one, from which cuts and containment are read off.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushtable.llm.common import forget, materialize, mix, small_batches

#: Where pieces end, and between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
TABLE = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))
#: Bytes of text of one language in a block, and of all languages that a task has open.
BLOCK, OPEN = 8 << 20, 24 << 20
#: Occurrences of a level for each part, and bytes of text for each part of the first level.
PART, FIRST_PART = 2_000_000, 32 << 20
BLOCKS = "block long, lang string, part int, size long, data binary"
NAMES = "block long, lang string, part int, data binary, id long, left long, right long, word string, f long"


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, bytes of equal weight together, compressed."""
    import zstandard

    return zstandard.compress(b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays), 1)


def unpacked(data: bytes, n: int = 1) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in flat]


def cut_up(text: bytes, most: int = 1 << 20):
    """A text in parts of about `most` bytes that end where a piece does; one piece is never cut."""
    text, begin = text.lower().translate(TABLE), 0  # bytes: A to Z alone are lowered
    while len(text) - begin > most and (end := text.find(b"\n", begin + most)) >= 0:
        yield text[begin:end]
        begin = end
    yield text[begin:]


def by_part(parts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list]:
    """The place of each item when they are sorted by part, then as given; and (part, items) of each part in turn."""
    order = order[np.argsort(parts[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found, at = np.unique(parts[order], return_index=True)
    return place, list(zip(found.tolist(), np.split(order, at[1:]) if len(at) else []))


def first_blocks(lang: str, texts: list[bytes], block: int, parts: int):
    """Rows of one block: its words as places in part order (0 ends a piece), and each part's words with their counts."""
    import pyarrow as pa
    import xxhash
    import zstandard

    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    number[b"\n"], number[b""]
    seqs = []
    for text in texts:
        words = (b"\n" + text).replace(b"\n", b" \n ").split(b" ")
        seqs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    seq = seq[seq != 1]
    words = list(number)[2:]
    counts = np.bincount(seq, minlength=len(number))[2:]
    part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int64, len(words))
    place, dealt = by_part(part, np.arange(len(words)))
    places = np.concatenate([[0, 0], place + 1])
    rows = [(block, lang, -1, int(counts.sum()), packed(places[seq]))]
    for p, own in dealt:
        own_counts = packed(counts[own])
        rows.append((block, lang, p, len(own), len(own_counts).to_bytes(8, "little") + own_counts + zstandard.compress(b"\n".join(words[i] for i in own), 1)))
    columns = zip(*rows)
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "lang", "part", "size", "data"])


def blocks_of(docs: DataFrame, lang: str, text: str, parts: int) -> DataFrame:
    """Rows of all blocks (BLOCKS); part -1 is the block's own sequence, whose size is its number of words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")

    def run(batches):
        from pyspark import TaskContext

        open_, sizes, block = defaultdict(list), defaultdict(int), TaskContext.get().partitionId() << 32
        for batch in batches:
            for name, whole in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for piece in cut_up(whole.as_py()):
                    open_[name].append(piece)
                    sizes[name] += len(piece)
                    full = name if sizes[name] >= BLOCK else max(sizes, key=sizes.get) if sum(sizes.values()) >= OPEN else None
                    if full is not None:
                        yield first_blocks(full, open_.pop(full), block, parts)
                        block, _ = block + 1, sizes.pop(full)
        for name in sorted(open_):
            yield first_blocks(name, open_[name], block, parts)
            block += 1

    return texts.mapInArrow(run, BLOCKS)


def back_and_names(frame, cuts: np.ndarray, flat: np.ndarray, ids: np.ndarray, last: bool):
    """Rows that take each block's names back to it: those of its items, in the order it sent them."""
    import pandas as pd

    split = [] if last else np.split(ids[flat], cuts[1:-1])
    return pd.DataFrame({"block": frame["block"][: len(split)], "lang": frame["lang"][: len(split)], "part": frame["part"][: len(split)], "data": [packed(x) for x in split]})


def names_frame(frame, back, **names):
    import pandas as pd

    out = pd.concat([back, pd.DataFrame(names)], ignore_index=True)
    for c in ("block", "part", "id", "left", "right", "f"):
        out[c] = out[c].astype("Int64") if c in out else pd.array([None] * len(out), "Int64")
    for c in ("lang", "data", "word"):
        out[c] = out[c].astype(object).where(out[c].notna(), None) if c in out else None
    return out[["block", "lang", "part", "data", "id", "left", "right", "word", "f"]]


def name_words(frame, parts: int, least: int):
    """Rows of NAMES of one part: what goes back to each block, and the frequent words with their counts."""
    import zstandard

    part, found, backs, index = int(frame["part"].iloc[0]), defaultdict(list), [], 0
    for lang, rows in frame.sort_values("block").groupby("lang", sort=True):
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        rows, flat, counts = rows.reset_index(drop=True), [], []
        for data in rows["data"]:
            n = int.from_bytes(data[:8], "little")
            counts.append(unpacked(data[8 : 8 + n])[0])
            flat.append(np.fromiter(map(number.__getitem__, zstandard.decompress(data[8 + n :]).split(b"\n")), np.int64, len(counts[-1])))
        cuts = np.cumsum([0, *map(len, flat)])
        flat, words = np.concatenate(flat), list(number)
        f = np.bincount(flat, np.concatenate(counts)).astype(np.int64)
        ids = np.zeros(len(f), np.int64)
        frequent = sorted(np.flatnonzero(f >= least).tolist(), key=words.__getitem__)
        ids[frequent] = 1 + part + parts * np.arange(index, index + len(frequent))
        index += len(frequent)
        backs.append(back_and_names(rows, cuts, flat, ids, False))
        found["id"] += ids[frequent].tolist()
        found["f"] += f[frequent].tolist()
        found["lang"] += [lang] * len(frequent)
        found["word"] += [words[i].decode(errors="replace") for i in frequent]
    import pandas as pd

    return names_frame(frame, pd.concat(backs, ignore_index=True), **found)


def name_pairs(frame, parts: int, least: int, last: bool):
    """The same for pairs of names; equal names are of one language, so pairs need not know theirs."""
    part, frame = int(frame["part"].iloc[0]), frame.sort_values("block").reset_index(drop=True)
    arrays = [unpacked(data, 3) for data in frame["data"]]
    cuts = np.cumsum([0, *(len(a[0]) for a in arrays)])
    lefts, at_left = np.unique(np.concatenate([np.cumsum(a[0]) for a in arrays]), return_inverse=True)
    rights, at_right = np.unique(np.concatenate([a[1] for a in arrays]), return_inverse=True)
    pairs, flat = np.unique(at_left * len(rights) + at_right, return_inverse=True)
    f = np.bincount(flat, np.concatenate([a[2] for a in arrays])).astype(np.int64)
    ids = np.zeros(len(f), np.int64)
    frequent = np.flatnonzero(f >= least)
    ids[frequent] = 1 + part + parts * np.arange(len(frequent))
    back = back_and_names(frame, cuts, flat, ids, last)
    pairs = pairs[frequent]
    return names_frame(frame, back, id=ids[frequent], left=lefts[pairs // len(rights)], right=rights[pairs % len(rights)], f=f[frequent])


def next_blocks(frame, parts: int, last: bool):
    """A block with its items' names in place: its distinct pairs of adjacent names, dealt over parts, and their sequence.

    What has no name breaks the sequence; breaks in a row become one.
    """
    import pandas as pd

    frame = frame.sort_values("part")
    block, lang = int(frame["block"].iloc[0]), frame["lang"].iloc[0]
    names = [unpacked(data)[0] for data in frame["data"].iloc[1:]]
    ids = np.concatenate([[0], *names])[unpacked(frame["data"].iloc[0])[0]]
    known, at = np.unique(ids, return_inverse=True)
    ok = (ids[:-1] > 0) & (ids[1:] > 0)
    pairs, own, counts = np.unique((at[:-1] * len(known) + at[1:])[ok], return_inverse=True, return_counts=True)
    left, right = known[pairs // len(known)], known[pairs % len(known)]
    hashed = mix(mix(left.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
    place, dealt = by_part((hashed % np.uint64(parts)).astype(np.int64), np.arange(len(pairs)))
    rows = []
    if not last:
        seq = np.zeros(len(ok), np.int64)
        seq[ok] = place[own] + 1
        rows.append((block, lang, -1, int(ok.sum()), packed(seq[(seq > 0) | np.concatenate([[False], seq[:-1] > 0])])))
    rows += [(block, lang, p, len(i), packed(np.diff(left[i], prepend=0), right[i], counts[i])) for p, i in dealt]
    return pd.DataFrame(rows, columns=["block", "lang", "part", "size", "data"])


def given(function, *more):
    """A function of a frame alone, as groups are handed over."""
    return lambda frame: function(frame, *more)


def named_levels(docs: DataFrame, lang: str, text: str, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words counted by language (lang, n), and the frequent phrases of each level: (id, lang, word, f), then (id, left, right, f)."""
    small_batches(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(16, -(-n_bytes // FIRST_PART))
    blocks = materialize(blocks_of(docs, lang, text, parts))
    n = materialize(blocks.where("part = -1").groupBy("lang").agg(F.sum("size").alias("n")))
    words = n.agg(F.sum("n")).first()[0] or 0
    named = materialize(blocks.where("part >= 0").groupBy("part").applyInPandas(given(name_words, parts, least), NAMES))
    levels = [named.where("block is null").select("id", "lang", "word", "f")]
    parts = max(16, -(-words // PART))
    for level in range(2, longest + 1):
        last = level == longest
        back = named.where("block is not null").select("block", "lang", "part", F.lit(0).cast("long").alias("size"), "data")
        both = blocks.where("part = -1").unionByName(back)
        before, blocks = blocks, materialize(both.groupBy("block").applyInPandas(given(next_blocks, parts, last), BLOCKS))
        forget(before)
        named = materialize(blocks.where("part >= 0").groupBy("part").applyInPandas(given(name_pairs, parts, least, last), NAMES))
        levels.append(named.where("block is null").select("id", "left", "right", "f"))
    forget(blocks)
    return n, levels


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000) -> DataFrame:
    """Phrases of 2 to `longest` words, at least `least` times within pieces, by the score of their weakest cut.

    A to Z are lowered; pieces end at `. , ; : ! ?` and line ends, words at spaces and tabs. Counts are by language; a null
    language is `und`, a null text empty. l and r count the two parts of the cut, n all words of the language. The score is
    floor(1000000 a a / (l r)), exact; of equal cuts the first counts. A phrase is dropped if a longer frequent one holds it and
    has at least `covered` percent of its count. `top` phrases of each language are kept (None: all), by score, count and
    phrase in byte order, so ties have one order. Repeated rows count each. A table without words has no rows.
    Returns lang, rank, phrase, a, l, r, n, score.
    """
    n, levels = named_levels(docs, lang, text, longest, least)
    none = F.array().cast("array<long>")
    table = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))
    scored = []
    for level, pairs in enumerate(levels[1:], 2):
        first = table.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_phrase"), F.concat("heads", F.array("f")).alias("heads"))
        final = table.select(F.col("id").alias("right"), F.col("last"), F.concat("tails", F.array("f")).alias("tails"))
        joined = pairs.join(first, "left").join(final, "right")
        joined = joined.select("id", "left", "right", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f", "heads", "tails")
        table = materialize(joined)
        if level > 2:  # by Apriori a longer phrase that covers has a part one word longer that does
            holds = table.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            scored[-1] = scored[-1].join(holds, "id", "left").where(f"longer is null or 100 * longer < {covered} * f").drop("longer")
        scored.append(table)
    out = None
    for size, phrases in enumerate(scored, 2):
        best = None
        for k in range(1, size):
            l, r = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
            cut = F.struct(_floor_score("f", l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
            best = cut if best is None else F.least(best, cut)
        part = phrases.select("lang", "phrase", F.col("f").alias("a"), best.alias("cut"))
        out = part if out is None else out.unionByName(part)
    out = out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # first within shares of a language, so that no task sorts a whole one
        share = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("_share")
        out = out.withColumn("_share", share).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(f"_at <= {top}").drop("_share", "_at")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        out = out.where(f"rank <= {top}")
    return out.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _floor_score(f: str, l, r):
    """Whole decimals hold the products: counts up to 10 ** 16 are exact."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = wide(F.lit(1_000_000)) * wide(F.col(f)) * wide(F.col(f))
    low = wide(l) * wide(r)
    return F.call_function("div", top, low)
