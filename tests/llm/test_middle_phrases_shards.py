import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hushtable.llm import collocations, fill_in_middle, sharding

ODD = [None, "", " ", "a", "<P>", "x<M>y", "<", "<<S", "é🙂日本́", "a\nb\r\n\tc", "\x00\x01", "ab" * 40_000, "<S" * 900]


def table(spark, texts, lang="en"):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, lang, "own", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, form string, n long")


# fill in the middle


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middles_against_plain_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b ", "é", "\n", "<", "S>", "🙂"]) for _ in range(rng.randint(0, 3000))) for _ in range(120)]
    docs = table(spark, texts)
    docs = docs.unionAll(docs.where("doc_id < 3")).unionAll(spark.createDataFrame([(None, "no id", "en", "own", 1)], docs.schema))
    made = fill_in_middle.fill_in_middle(docs, keep=("form", "n")).withColumn("restored", fill_in_middle.restored()).collect()
    assert len(made) == len(texts) + 4
    for r in made:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, text) and r.restored == (text or "")
        assert r.form_input == "own"
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pattern", [r"(?s:.)", r"\w+\s*", r"\d+", r"[ab]+?", r"(?<=a)b|c", r"(a)(b)?"])
def test_matches_are_those_of_one_search_after_the_other(pattern):
    rng = random.Random(pattern)
    units = fill_in_middle.Matches(pattern)
    for size in (0, 1, 30, 40, 1023, 1024, 1025, 5000):
        text = "".join(rng.choice(["a", "b", "c ", "1", "é", "\n", "ab", "ab"]) for _ in range(size))
        ends = [0, *(m.end() for m in re.finditer(pattern, text))]
        assert units.advance(text, 0) == (len(ends) - 1, ends[-1])
        a, b = sorted(rng.randrange(len(ends)) for _ in range(2))
        assert fill_in_middle.places(units, text, a, b) == (ends[a], ends[b])


def test_words_as_units(spark):
    made = fill_in_middle.fill_in_middle(table(spark, ["one two  three four", "…"]), unit=r"\S+", rate=100, spm=0).orderBy("doc_id").collect()
    assert made[0].n == 4 and made[0].prefix_chars in (0, 3, 7, 14, 19) and made[1].n == 1
    with pytest.raises(ValueError):
        fill_in_middle.Matches(r"\d*")


# phrases


def plain_phrases(rows, longest=3, least=10, covered=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def sentences(rng, k):
    words = ["der", "Die", "das", "é", "É", "x\x1fy", "New", "york", "city", "of", "a", "\x00"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randint(0, 60))) for _ in range(k)]


@pytest.mark.parametrize("longest,top,block", [(3, 2000, None), (4, 5, 300), (2, 2000, 50)])
def test_phrases_against_plain_python(spark, monkeypatch, longest, top, block):
    rng = random.Random(longest)
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in sentences(rng, 120)] + [(None, "en"), ("", None), ("new york city " * 3000, "en"), ("same same " * 12, "fr")] * 2
    if block:  # so that a language has many blocks, and a level many parts
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "PART", 20)
        monkeypatch.setattr(collocations, "FIRST_PART", 1000)
    docs = spark.createDataFrame([(i, t, l, 5, "p") for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string").repartition(5)
    found = collocations.collocations(docs, longest=longest, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == plain_phrases(rows, longest, top=top)


def test_phrases_of_nothing(spark):
    for texts in ([], [None], ["", " .,\n"], ["too few words"]):
        assert collocations.collocations(table(spark, texts)).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 4_000_000_019, 4_100_000_007, 9_000_000_011
    got = spark.createDataFrame([(a, l, r)], "f long, l long, r long").select(collocations._floor_score("f", F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * a * a // (l * r)


def test_blocks_end_where_pieces_do():
    text = ("word " * 50 + "\n") * 40 + "x" * 5000
    parts = list(collocations.cut_up(text.encode(), 1000))
    assert len(parts) > 5 and b"".join(parts) == text.encode() and all(p.startswith(b"\n") for p in parts[1:])


# shards


def plain_best_fit(sizes, capacity):
    """Groups one by one, largest first, each into the fullest bin that takes it."""
    room, bins = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            r, i = min(fits)
        else:
            room.append(max(capacity, s))
            i = len(room) - 1
        room[i] -= s
        bins.append(i)
    return bins


def test_runs_place_groups_as_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes = rng.integers(1, rng.integers(2, 60), rng.integers(0, 80))
        capacity = int(rng.integers(10, 120))
        values, counts = np.unique(-sizes, return_counts=True)
        plan = sharding.best_fit(-values, counts, capacity)
        want = plain_best_fit(sizes.tolist(), capacity)
        got = plan.bins[np.searchsorted(plan.starts, np.arange(len(sizes)), side="right") - 1].tolist() if len(sizes) else []
        assert got == want and plan.used == len(set(want))


def test_least_capacity_is_the_first_that_fits():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 90, rng.integers(1, 60))
        values, counts = np.unique(-sizes, return_counts=True)
        plan = sharding.least_capacity(-values, counts, 4)
        assert max(plain_best_fit(sizes.tolist(), plan.capacity)) < 4
        low = max(-(-int(sizes.sum()) // 4), int(sizes.max()))
        assert plan.capacity <= 2 * low and (plan.capacity == low or max(plain_best_fit(sizes.tolist(), plan.capacity - 1)) >= 4)


def checked(spark, docs, **how):
    rows = sharding.shard_texts(docs, keep=("text", "size"), **how).collect()
    assert len(rows) == docs.count()
    homes, slots, loads = {}, defaultdict(list), Counter()
    for r in rows:
        text = (r.text or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        assert homes.setdefault(text, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, loads


def test_shards_are_near_equal_and_groups_whole(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 4000) for _ in range(300)] + ["hot copy " * 20] * 400 + [None, "", "é"] * 5
    docs = spark.createDataFrame([(i % 350, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, size long")
    rows, loads = checked(spark, docs)
    assert rows[0].size_input == 9 and set(loads) <= set(range(8))
    sizes = Counter((t or "").encode() for t in texts)
    largest = max((len(t) + 1) * n for t, n in sizes.items())
    total = sum(loads.values())
    assert max(loads.values()) <= max(largest, total / 8 * 1.02)
    again = sharding.shard_texts(docs.repartition(9), keep=("text", "size")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert Counter(map(key, rows)) == Counter(map(key, again))


def test_fixed_capacity_uses_as_few_shards_as_best_fit(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["c" * 5000]
    docs = table(spark, texts)
    rows = sharding.shard_texts(docs, shards=None, capacity=1000).collect()
    sizes = Counter(texts)
    want = plain_best_fit([(len(t) + 1) * n for t, n in sizes.items()], 1000)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert len(loads) == len(set(want)) and all(x <= 1000 or x == 5001 for x in loads.values())
    for wrong in (dict(shards=None), dict(shards=4, capacity=5), dict(shards=0)):
        with pytest.raises(ValueError):
            sharding.shard_texts(docs, **wrong)


def test_large_sizes_are_rounded_up_a_little(spark):
    sizes = [1, 2**15 - 1, 2**15, 2**15 + 1, 10**6 + 1, 2**40 + 12345]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.rounded(sharding.F.col("s"))).collect()]
    assert got[:3] == sizes[:3] and all(s <= g <= s * (1 + 2.0 ** (1 - sharding.BITS)) for s, g in zip(sizes, got))


def test_no_rows_and_few_rows(spark):
    assert sharding.shard_texts(table(spark, [])).count() == 0
    rows, loads = checked(spark, spark.createDataFrame([(None, None, 1), (None, None, 1), (1, "a", 1)], "doc_id long, text string, size long"))
    assert len(loads) == 2


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = table(spark, [f"text {i}" * (i % 7) for i in range(90)])
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.lang) for r in got.collect()) == sorted((r.doc_id, r.text, r.lang) for r in docs.collect())
