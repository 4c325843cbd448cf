"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hushtable.llm import byte_bpe, collocations, fill_in_middle, html_extraction, jaccard_join, language_id, neighbours, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity
from hushtable.llm.common import remainder
from hushtable.llm.sql import ORACLE  # noqa: F401


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark, sf_dir):
    docs, path = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(docs.where(~remainder("doc_id", 4).eqNullSafe(2)), path)
    found = language_id.identify(docs, model, path)
    return found.select("doc_id", remainder("doc_id", 4).eqNullSafe(2).alias("held_out"), "lang_pred", "score")


def op2_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality_classifier.train(docs, labels(spark, sf_dir).where(~remainder("doc_id", 5).eqNullSafe(0)))
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", remainder("doc_id", 5).eqNullSafe(0).alias("held_out"), "score", "predicted")


def op3_learned_partitions(spark, sf_dir):
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, labels(spark, sf_dir).where(~remainder("doc_id", 3).eqNullSafe(1)))
    found = toxicity.score(docs, model, level=0.05)
    return found.select("doc_id", remainder("doc_id", 3).eqNullSafe(1).alias("held_out"), "score", "predicted", "n_segments")


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op6_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extraction.extract(pages, html_extraction.train(pages))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.join(documents(spark, sf_dir))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    digests = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), fill_in_middle.restored())]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


def op13_sharding(spark, sf_dir):
    found = sharding.shard_texts(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_learned_partitions, op4_toxicity, op5_quality_rules,
        op6_html_extraction, op7_jaccard_join, op8_token_counts, op9_packing, op10_byte_bpe, op11_fill_in_middle, op12_collocations, op13_sharding,
    )
}
