"""Nulls, repeated rows, long texts and clashing columns, for the operators that give a row for each row."""

from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hushtable.llm import byte_bpe, html_extraction, language_id, packing, quality_classifier, quality_rules, token_counts, toxicity

WORDS = {"en": "the cat sat on this mat and was happy with it", "de": "der Hund lief durch den Wald und war sehr müde"}
TEXTS = [None, "", " \n", "…", "the cat", *[f"{w} {i}" for i in range(20) for w in WORDS.values()], "ab " * 60_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de"][i % 2], "own", 0.5) for i, t in enumerate(TEXTS)]
    rows += rows[:6] + [(None, "no id", None, None, None), (3, "another text of one id", "en", "own", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in [*range(40), 5, 5, 10**6]] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def each(docs, labels):
    yield "language", lambda d: language_id.identify(d, language_id.train(d, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model")), ("lang_pred", "score")
    yield "quality", lambda d: quality_classifier.score(d, quality_classifier.train(d, labels)), ("score", "predicted")
    yield "toxicity", lambda d: toxicity.score(d, toxicity.train(d, labels)), ("score", "predicted")
    yield "rules", quality_rules.quality_rules, ("n_words", "kept")
    yield "tokens", lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json")), ("n_bytes", "n_tokens", "over_limit")
    yield "bytes", lambda d: byte_bpe.encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), ("n_tokens", "ids_sha256")


@pytest.mark.parametrize("which", range(6))
def test_every_row_comes_back_once_and_equal_rows_alike(spark, docs, labels, which):
    name, run, columns = list(each(docs, labels))[which]
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    got = run(docs).select("doc_id", *columns).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in given.elements())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert all(len(found) == 1 for i, found in by_id.items() if i not in (3,)) and len(by_id[3]) <= 2
    assert all(v is not None for r in got for v in tuple(r)[1:])
    assert run(docs.limit(0)).count() == 0


def test_packing_counts_repeated_rows_each(spark, docs):
    counted = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"))
    packed = packing.pack(counted, length=F.col("n_tokens")).collect()
    total = counted.agg(F.sum("n_tokens")).first()[0]
    assert sum(r.n_tokens for r in packed) == total and Counter(r.doc_id for r in packed if r.segment == 0) == Counter(r.doc_id for r in docs.collect())


def test_pages_without_text_and_repeated_pages(spark):
    page = "<html><body><nav><a>menu</a></nav><article><p>" + "A long sentence about things. " * 8 + "</p></article></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = html_extraction.extract(pages, html_extraction.train(pages)).collect()
    assert len(got) == 5 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert len({r.text for r in got if r.page_id == 1}) == 1
    assert html_extraction.extract(pages.limit(0), html_extraction.train(pages.limit(0))).count() == 0
