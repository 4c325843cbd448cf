import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hushtable.llm import byte_bpe, html_extraction, jaccard_join, language_id, neighbours, packing, quality_classifier, quality_rules, token_counts, toxicity

PIECES = ["the", "a ", "\n", "\n\n", " ", "     ", "é", "日本", "'s", "12", "!!", "<|endoftext|>", "<|end", "x" * 50, "\t", "🙂", "don't"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")


def test_splicing_gives_the_same_ids():
    rng, tokenizer = random.Random(1), token_counts.load(P.path("byte_bpe_50k.json"))
    for k in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 1500))) + "a" * (3000 * (k % 10 == 0))
        assert token_counts.spliced_ids(tokenizer, text, rng.choice([100, 300]), rng.choice([70, 150])) == tokenizer.encode(text, add_special_tokens=False).ids


def test_byte_bpe_against_the_library(spark):
    import regex
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", *("".join(rng.choice(PIECES) for _ in range(200)) for _ in range(20))]
    for r in byte_bpe.encode_decode(docs_of(spark, texts), path, P.PATTERN, ids=True).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert regex


def test_quality_rules_edges(spark):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs_of(spark, [None, "", "a b c d e a b c d e", "the " * 12, "x#y"])).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[1].kept
    assert got[2].n_repeat_words == 10 and got[3].n_repeat_words == 12 and got[4].n_symbols == 1


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, width, num):
    rng = random.Random(width)
    texts = [None, "", "  ", "one", "one", "One two"]
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 50)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, texts), width=width, num=num).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_rows_that_share_an_id_link_as_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (2, b), (3, a), (3, b), (5, c), (7, None), (9, c), (9, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == {(1, 18, 1), (2, 18, 1), (3, 18, 1), (5, 18, 5), (7, 0, 7), (9, 18, 5), (9, 0, 5), (None, 18, 1)}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[40:80] = x[40]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", k=5).collect()
    for q in range(0, 300, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(300), -np.round(s, 9))) if i != q][:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_several_partitions_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16))).round(3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(i, [float(v) for v in x[i]]) for i in range(0, 1500, 50)]
    rows += [(7, [float(v) for v in x[8]]), (5000, [1.0, 2.0]), (5020, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, "vec_id % 20 = 0", k=10, rows_a_part=150).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[7] = max(s[7], s[8])
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 10 and own.vec_id.is_unique and q not in set(own.vec_id) and np.allclose(own.score, s[own.vec_id])
        hits += len(set(own.vec_id) & set(sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 9), i))[:10]))
    assert hits >= 0.9 * 75 * 10
    assert got[got.query_id.isin([5000, 5020])].sort_values("query_id")[["query_id", "vec_id", "score"]].values.tolist() == [[5000, 5020, 4.0], [5020, 5000, 4.0]]


def test_packing_keeps_every_token(spark):
    texts = [None, "", *("w " * n for n in (1, 31, 32, 33, 100, 5000, 9000))] * 3
    out = packing.pack(docs_of(spark, texts), longest=4096, budget=8192).toPandas()
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert (out.n_tokens <= out.bucket_len).all() and not out.duplicated(["batch_id", "place"]).any()
    assert (out.groupby("batch_id").size() * out.groupby("batch_id")["bucket_len"].first() <= 8192).all()


def test_bounds_are_optimal():
    from itertools import combinations

    counts = np.array([5, 0, 3, 8, 1, 2])
    cost = lambda bounds: sum(c * next(b for b in bounds if b >= i) for i, c in enumerate(counts, 1))
    assert cost(packing.optimal_bounds(counts, 3)) == min(cost((*c, 6)) for k in range(3) for c in combinations(range(1, 6), k))


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        gains = [rng.choice([0, 0, 0, 1.0, 2.0]) for _ in range(15)]
        line = [g or -0.25 for g in gains]
        best = max([sum(line[i:j]) for i in range(15) for j in range(i + 1, 16)])
        places = [i for i, g in enumerate(gains) if g]
        got = toxicity.segments(places, [gains[i] for i in places])
        assert (abs(max(s for s, _, _ in got) - best) < 1e-9) if got else best <= 0


def test_equal_passages_get_equal_segments(spark):
    passage, calm = "vile brute vile vile brute", "the cat sat on a mat " * 500
    for lexicon in ({"vile": 3.0, "brute": 1.0}, {"vile": 3.0, "brute": 1.0, "cat": -0.5}):
        model = {"lexicon": lexicon, "tail": (1.0, 1e-3), "logistic": (1.0, -1.0)}
        docs = docs_of(spark, [f"vile {calm}" + f"{passage} {calm}" * 10, passage])
        long, short = (r.segments for r in toxicity.score(docs, model, spans=True).orderBy("doc_id").collect())
        assert [s.score for s in short] == [11.0] and [s.score for s in long] == [3.0] + [11.0] * 10
        assert {s.last - s.first for s in long[1:]} == {4}


def test_milder_words_keep_their_log_odds(spark):
    docs = docs_of(spark, [" ".join(w for w, k in (("vile", 4), ("mild", 6), ("kind", 1)) if i % 10 < k) + " x" if i < 200 else " ".join(w for w, k in (("mild", 2), ("kind", 6)) if i % 10 < k) + " x" for i in range(400)])
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)["lexicon"]
    assert 0 < lexicon["mild"] < 2 and lexicon["kind"] < 0 < lexicon["vile"] and "x" not in lexicon


def test_scores_without_labels_or_text(spark):
    docs = docs_of(spark, [None, "", "word"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(docs, none) is None and toxicity.train(docs, none) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(docs, None).collect()} == {0}


def test_leaves_and_labels():
    page = '<html><title>T</title><script>var t="</p>";</script><body><nav><a href="/">menu</a></nav><article><h1>A &amp; B</h1><p>one<br>two<p>three</article><div class="ad">buy</div>'
    assert [t for _, t, _, main in html_extraction.leaves(page) if main] == ["A & B", "one two", "three"]


def test_text_of_other_elements_stays_and_depth_costs_nothing():
    page = "<article><p>let <math><mi>x</mi> = 2</math> and<noscript> so</noscript></p><svg><text>label</text></svg><object> alt"
    assert " ".join(t for _, t, _, main in html_extraction.leaves(page) if main) == "let x = 2 and so label alt"
    import time

    began = time.time()
    assert len(html_extraction.leaves("<div>a<b>" * 30_000)) == 30_000
    assert time.time() - began < 20


def test_lstm_gradients():
    rng = np.random.default_rng(1)
    x, mask, w, b = rng.normal(size=(4, 3, 5)), np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], float), rng.normal(size=(5 + html_extraction.HIDDEN, 4 * html_extraction.HIDDEN)), rng.normal(size=4 * html_extraction.HIDDEN)
    aim = rng.normal(size=(4, 3, html_extraction.HIDDEN))
    loss = lambda x, w, b: float((html_extraction.lstm(x, mask, w, b)[0] * aim).sum())
    dx, dw, db = html_extraction.lstm_back(aim, html_extraction.lstm(x, mask, w, b)[1], w)
    for value, grad in ((x, dx), (w, dw), (b, db)):
        for _ in range(6):
            at = tuple(rng.integers(n) for n in value.shape)
            keep, value[at] = value[at], value[at] + 1e-5
            up = loss(x, w, b)
            value[at] = keep - 1e-5
            down = loss(x, w, b)
            value[at] = keep
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5 * (1 + abs(grad[at]))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    calm = cp.materialize(cp.toxicity(spark, docs, sf))
    kept = cp.materialize(cp.near_copies(spark, calm, sf)).toPandas()
    groups = jaccard_join.join(calm, width=cp.WORDS, num=cp.NEAR).toPandas()
    assert sorted(kept.doc_id) == sorted(groups.component_id.unique()) and list(kept.columns) == list(cp.COLUMNS)
    assert calm.where(F.col("text").isNull()).count() == docs.where(F.col("text").isNull()).count()


def shingle_sets(texts, width):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]


def linked(a, b, num):
    return bool(a and b) and 100 * len(a & b) >= num * len(a | b)


def families(seed, n, most):
    """Groups of near copies of one text, each copy with a few words changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, most)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 50)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [3])
def test_long_lists_in_blocks_and_string_ids(spark, block):
    texts = families(11, 6, 30)
    ids = [f"d{(i * 37) % 1000:03}" for i in range(len(texts))]
    sets = shingle_sets(texts, 3)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")
    least = dict(zip(ids, ids))
    changed = True
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if linked(sets[i], sets[j], 90)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, block=block).collect()}
    assert got == least


def test_plans_do_not_grow_with_the_turns(spark, monkeypatch):
    write, leaves = jaccard_join.materialize, []

    def noted(df):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return write(df)

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    jaccard_join.join(docs_of(spark, families(11, 6, 30)), block=3)
    assert max(leaves) <= 10


@pytest.mark.parametrize("most", [40, 100_000])
def test_components_in_one_task_and_in_many(spark, most):
    rng = random.Random(5)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s500", f"s{i:03}") for i in range(0, 90, 3)]
    pairs += [(f"r{rng.randrange(80):03}", f"r{rng.randrange(80):03}") for _ in range(50)] + [("c003", "c004"), ("x", "x")]
    rng.shuffle(pairs)
    least = {x: x for pair in pairs for x in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    found = jaccard_join.components(spark.createDataFrame(pairs, "a string, b string").repartition(5), most).collect()
    assert sorted((r["id"], r["component"]) for r in found) == sorted((x, m) for x, m in least.items() if x != m)


def test_large_ids_beside_null_ones(spark):
    big = 2**60
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(big + 1, a), (big + 2, a), (big + 3, b), (None, b), (big + 4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == {(big + 1, big + 1), (big + 2, big + 1), (big + 3, big + 3), (None, big + 3), (big + 4, big + 4)}


@pytest.mark.parametrize("block", [4])
def test_all_links_against_brute_force(spark, block):
    texts = [None, "", "one", "one", *families(12, 8, 12)]
    sets = shingle_sets(texts, 3)
    found, members = jaccard_join.links(docs_of(spark, texts), block=block)
    members = {r.doc_id: (r.class_id, r.n_links) for r in members.collect()}
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(frozenset(s), i)
    assert {k: v[0] for k, v in members.items()} == {i: first.get(frozenset(s)) for i, s in enumerate(sets)}
    assert {k: v[1] for k, v in members.items()} == {i: sum(linked(s, o, 90) for j, o in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and linked(sets[a], sets[b], 90)}
    got = [(r.a, r.b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_forward_sums_over_all_segmentations():
    known = language_id.vocabulary(P.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) == p.lower() and (p == "▁" or p.strip("▁").isalpha() and p.find("▁", 1) < 0)}
    assert len(known[0]) == len(pieces) + 1 and known[2] == max(map(len, pieces)) > 6
    number = {}
    for piece in pieces:
        points = np.frombuffer(piece.encode("utf-32-le"), np.uint32).reshape(1, -1)
        number[piece] = int(language_id.piece_numbers(language_id.prefix_hashes(points), 0, len(piece), known)[1][0])
    assert sorted(number.values()) == list(range(1, len(pieces) + 1))
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(len(pieces) + 1), 2).T

    def total(text, k):
        return 1.0 if not text else sum((p[number[text[:n]], k] if text[:n] in number else p[0, k] if n == 1 else 0.0) * total(text[n:], k) for n in range(1, len(text) + 1))

    for word in ("a", "ing", "information", "qx"):
        got = language_id.word_scores([word], p, known)[0]
        assert np.allclose(got, [np.log(total("▁" + word, k)) for k in range(2)], rtol=1e-6)
    # logarithms give the same sums, and long words are scored whole
    points = np.frombuffer("▁information".encode("utf-32-le"), np.uint32).reshape(1, -1)
    assert np.allclose(language_id.by_logarithms(points, np.log(p), known)[0][-1, 0], language_id.word_scores(["information"], p, known)[0])
    assert np.isfinite(language_id.word_scores(["ab" * 500], p, known)).all()
    flat = np.full((len(known[0]), 1), 1 / len(known[0]))
    short, long = (language_id.expected_pieces([w], np.ones(1), flat, known)[0] for w in ("the" * 3, "the" * 40))
    length = np.array([1, *[len(x) for x, _ in sorted(number.items(), key=lambda x: x[1])]])
    assert np.isclose(short @ length, 10) and np.isclose(long @ length, 121)


def test_languages_are_told_apart(spark):
    words = {"x": "alpha beta gamma delta", "y": "un deux trois quatre", "z": "eins zwei drei vier"}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(12)), k) for i, k in enumerate("xyz" * 20)]
    docs = spark.createDataFrame(rows + [(90, None, "x"), (91, "½ ² Ⅷ 7", "y"), (92, "Zwei" * 100, None), (93, "deux", "x")], "doc_id long, text string, lang string")
    path = P.path("piece_bpe_32k.model")
    model = language_id.train(docs, path)
    got = {r.doc_id: r for r in language_id.identify(docs, model, path).collect()}
    assert [got[i].lang_pred for i in range(60)] == list("xyz" * 20)
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == "z" and got[93].lang_pred == "y"


def test_counting_splices_huge_texts(spark):
    rng, path = random.Random(8), P.path("byte_bpe_50k.json")
    texts = [None, "", *("".join(rng.choice(PIECES) for _ in range(300)) for _ in range(12))]
    tokenizer = token_counts.load(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), path, huge=100, overlap=70).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}


def test_all_maximal_segments_against_brute_force():
    """The definition: of the segments that hold no better part and lie in no better segment of that kind, all maximal ones."""
    rng = random.Random(5)
    for _ in range(150):
        line = [rng.choice([-0.25, -0.25, -1.0, rng.uniform(0.2, 1), rng.uniform(1, 2)]) for _ in range(11)]

        def best(a, b):  # recursive definition: the best segment, then what is left of it on both sides
            runs = [(sum(line[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max(runs, key=lambda r: (round(r[0], 9), r[2] - r[1]), default=(0, 0, 0))
            return [] if top[0] <= 1e-9 else best(a, top[1]) + [(round(top[0], 6), top[1], top[2] - 1)] + best(top[2], b)

        places = [i for i, g in enumerate(line) if g != -0.25]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(places, [line[i] for i in places])]
        assert [s for s, *_ in got] == [s for s, *_ in best(0, 11)]


def test_descent_follows_the_gradient():
    rng = np.random.default_rng(3)
    bags, labels = [(np.array([2, 5, 9]), np.array([0.5, 0.3, 0.2], np.float32))], np.array([1])
    start, flat = quality_classifier.descend([], np.zeros(0, int), size=4, buckets=16)
    vectors, weights = quality_classifier.descend(bags, labels, size=4, epochs=1, rate=1e-3, buckets=16)
    mean = np.append(bags[0][1] @ start[bags[0][0]], 1.0)
    loss = lambda w: float(np.log(np.exp(mean @ w).sum()) - (mean @ w)[1])
    for i in range(5):
        for j in range(2):
            up = np.zeros((5, 2))
            up[i, j] = 1e-4
            slope = (loss(flat + up) - loss(flat - up)) / 2e-4
            assert abs((weights - flat)[i, j] + 1e-3 * slope) < 1e-6
    assert rng is not None and vectors.shape == start.shape


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = P.path("piece_bpe_32k.model")
    frames = [
        language_id.identify(none, language_id.train(none, path), path),
        quality_classifier.score(none, quality_classifier.train(none, labels), keep=("score",)),
        toxicity.score(none, toxicity.train(none, labels), keep=("score",)),
        token_counts.count_tokens(none, P.path("byte_bpe_50k.json")),
        jaccard_join.join(none),
        packing.pack(none),
        neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0"),
    ]
    assert [f.count() for f in frames] == [0] * 7 and frames[1].columns == ["doc_id", "score_input", "score", "predicted"]
