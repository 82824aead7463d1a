"""A training corpus from `documents`: toxic texts out, unknown languages out, copies out, near copies out, packed.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's docs. All but the last
return the columns of documents.

Defined cases, as in the operators: null texts are empty texts. Toxicity keeps them; language ID rejects texts
without a letter; of equal texts the row with the largest doc_id stays; of near copies (Jaccard of five-word shingles 0.8 or
more, in one piece) the row with the smallest doc_id; an empty table leaves an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.exact_dedup import without_copies
from plumbline.llm.langid import in_known_language, train_langid
from plumbline.llm.ngram_join import one_of_each
from plumbline.llm.packing import best_fit_packing
from plumbline.llm.toxicity import train_toxicity, without_toxic
from plumbline.session import scratch_dir

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, train_toxicity(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_known_language(docs, train_langid(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its ids and its place in a sequence."""
    return best_fit_packing(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

ORACLE_SQL = None  # models and packing are beyond SQL; tests/llm/test_pipeline.py compares with plain stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
