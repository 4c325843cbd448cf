import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hushtable.llm import packing, quality_classifier, token_counts
from hushtable.llm import toxicity as toxic
from hushtable.llm.common import remainder

SF = "/root/testdata/sf0.001"


def kept_by_scores(docs, labels, operator):
    model = operator.train(docs, labels)
    return {r.doc_id: r.predicted for r in operator.score(docs, model).select("doc_id", "predicted").collect()}


def smallest_of_components(texts):
    """Ids that stay: the smallest of each group linked by sets of 5-word shingles, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {root(i) for i in ids}


def test_all_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = kept_by_scores(docs, labels.where(~remainder("doc_id", 3).eqNullSafe(1)), toxic)
    calm = docs.where(F.col("doc_id").isin([i for i, p in told.items() if p == 0]))
    told = kept_by_scores(calm, labels.where(~remainder("doc_id", 5).eqNullSafe(0)), quality_classifier)
    left = smallest_of_components({i: texts[i] for i, p in told.items() if p == 1})
    tokenizer = token_counts.load(public_tokenizers.path(cp.TOKENIZER))
    want, lengths = {}, Counter()
    for i in left:
        n = len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids)
        for s in range(max(1, -(-n // 4096))):
            want[i, s] = min(4096, n - 4096 * s)
            lengths[max(want[i, s], 1)] += 1
    bounds = packing.optimal_bounds([lengths[k + 1] for k in range(4096)], 8)
    got = cp.run(spark, SF).collect()
    assert {(r.doc_id, r.segment): r.n_tokens for r in got} == want and len(got) == len(want) > 20
    batches = defaultdict(list)
    for r in got:
        assert r.bucket_len == min(b for b in bounds if b >= max(r.n_tokens, 1))
        batches[r.bucket_len, r.batch_id].append(r.place)
    short = Counter()
    for (length, _), places in batches.items():
        most = max(1, 32_768 // length)
        assert sorted(places) == list(range(len(places))) and len(places) <= most
        short[length] += len(places) < most
    assert max(short.values()) <= 1 and [s for s, _ in cp.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "packing"]


def test_stages_without_rows_or_text(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, None, 0), (2, "a b", "en", "s", 3)], docs.schema)
    for name, rows in (("none", docs.limit(0)), ("few", few)):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / name / "labels.parquet"))
        for _, stage in cp.STAGES[:-1]:
            kept = stage(spark, rows, str(tmp_path / name))
            assert kept.columns == list(cp.COLUMNS) and kept.count() <= rows.count()
        assert cp.pack(spark, rows, str(tmp_path / name)).count() == rows.count()
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
