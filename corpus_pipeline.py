"""From documents to packed batches: toxic and poor documents go, near copies go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows with a null doc_id are judged like
others, but name no document, so the stage on near copies leaves them in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushtable.llm import jaccard_join, packing, quality_classifier, token_counts
from hushtable.llm import toxicity as toxic_passages
from hushtable.llm.common import materialize, remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share so many percent of their shingles of so many words.
NEAR, WORDS = 80, 5
#: The tokenizer whose tokens are packed.
TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learns from the same fold of labels as the query on toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~remainder("doc_id", 3).eqNullSafe(1))
    model = toxic_passages.train(docs, labels)
    return toxic_passages.score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted good; learns from the same fold of labels as the query on quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~remainder("doc_id", 5).eqNullSafe(0))
    model = quality_classifier.train(docs, labels)
    return quality_classifier.score(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of rows that share an id, one."""
    found = jaccard_join.join(docs, width=WORDS, num=NEAR, den=100)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_chars", "source", "lang", "text"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("_row", once).where("_row = 1")
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what is left, by the tokens of a tokenizer: no batch goes over its budget of them."""
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(counted, length=F.col("n_tokens"))


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("packing", pack)]

#: SQL can't state trained models. The tests hold run() against plain Python: links by all pairs of sets, tokens by the
#: library, and the two classifiers' own scores of each document.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
