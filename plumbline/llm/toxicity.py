"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours, and pairs with one word between, hashed to
2**BITS coordinates. The labelled rows to learn from are bounded (`max_rows`, those of the smallest hash of
their key); their features are made where the rows are, one task runs EPOCHS passes over them, and
only the weights that L1 left above zero come back: at most 2**BITS, in practice a few
hundred. Scoring broadcasts them and reads every whole text.

Defined cases: null and empty texts score by the bias alone; without labels of both kinds every
text scores 0; a key labelled more than once counts as toxic if any label says so; null keys and
labels teach nothing; repeated rows are scored each; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, quoted, utf8, whole
from .ftrl import Ftrl

BITS = 20
MAX_ROWS = 16_000
EPOCHS = 4
ALPHA, L1, L2 = 1.0, 8.0, 0.01
MEMO = 500_000
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W_]+").findall
_memo: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Sorted coordinates of the text, without the bias."""
    return np.unique(_coordinates(text))


def _coordinates(text: str) -> np.ndarray:
    import xxhash

    if len(_memo) > MEMO:
        _memo.clear()
    words = _WORDS(text.lower())
    hashes = np.empty(len(words), "uint64")
    for i, word in enumerate(words):
        known = _memo.get(word)
        if known is None:
            known = _memo[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = known
    odd, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    pairs = (hashes[:-1] * odd) ^ hashes[1:]
    skips = (hashes[:-2] * odd + np.uint64(1)) * odd ^ hashes[2:]
    mixed = np.concatenate([hashes, pairs, skips]) * odd
    return (mixed >> step).astype("int64")


def _to_features(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        made = [features(t.decode()).astype("int32").tobytes() for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(made, pa.binary())], names=["label", "order", "at"])


def _learn(epochs: int):
    def task(batches) -> Iterator:
        import pyarrow as pa

        rows = [(label, np.frombuffer(at, "int32")) for b in batches for label, at in zip(b.column("label").to_pylist(), b.column("at").to_pylist())]
        bias = 1 << BITS
        model = Ftrl(bias + 1, alpha=ALPHA, l1=L1, l2=L2)
        rows = [(label, np.append(at, bias)) for label, at in rows]
        if len({label for label, _ in rows}) == 2:
            for _ in range(epochs):
                for label, at in rows:
                    w = model.weights(at)
                    gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
                    model.update(at, np.full(w.shape, gradient), w)
            w = model.weights()[:, 0]
            kept = np.flatnonzero(w)
        else:
            w, kept = np.zeros(0), np.zeros(0, "int64")
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w[kept], pa.float64())], names=["at", "weight"])

    return task


def train_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights by coordinate, from rows of fold other than 2 of 4."""
    known = labels.select(quoted(key).alias("key"), quoted(label).cast("int").alias("label")).dropna()
    known = known.where(fold_of("key", 4) != 2).groupBy("key").agg(F.max("label").alias("label"))
    known = known.withColumn("order", F.xxhash64("key")).orderBy("order").limit(max_rows)
    texts = df.select(quoted(key).alias("key"), whole(text).alias("text"))
    rows = texts.join(F.broadcast(known), "key").select("text", "label", "order")  # at most max_rows small rows
    made = rows.mapInArrow(_to_features, "label int, order long, at binary").orderBy("order").limit(max_rows)
    learned = made.coalesce(1).sortWithinPartitions("order", "at").mapInArrow(_learn(epochs), "at long, weight double")
    return {r["at"]: r["weight"] for r in learned.collect()}  # at most 2**BITS + 1


def toxicity_score(spark, weights: dict[int, float]):
    """A function from a text column to its score."""
    shared = spark.sparkContext.broadcast(weights)
    ready: dict = {}

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if "w" not in ready:
            table = np.zeros((1 << BITS) + 1, "float32")
            for at, weight in shared.value.items():
                table[at] = weight
            ready["w"] = table
        table, out = ready["w"], []
        if not shared.value:
            return pd.Series([0.0] * len(texts))
        for text in texts:
            at = _coordinates(text or "")
            at = np.unique(at[table[at] != 0])
            total = float(table[at].sum(dtype="float64")) + float(table[-1])
            out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))
        return pd.Series(out, dtype="float64")

    return score


def score_toxicity(df: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted."""
    score = toxicity_score(df.sparkSession, weights)
    rows = df.select(quoted(key).alias(key), (fold_of(key, 4) == 2).alias("held_out"), score(whole(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(df: DataFrame, weights: dict[int, float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` scored below the threshold, all columns as they were."""
    score: Column = toxicity_score(df.sparkSession, weights)(whole(text))
    return df.where(score < threshold)
