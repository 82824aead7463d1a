"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

One to three characters of the lower-cased text, ASCII other than letters read as spaces, are hashed to 2**BITS coordinates. Document
frequencies come from all rows that may teach. The model is fitted to a bounded number of them (`max_rows`,
those of the smallest hash of their key) by follow-the-regularised-leader with L1 and L2; one in
five is kept aside to set the temperature that calibrates the scores. Weights, frequencies and
languages are bounded by 2**BITS times the number of languages seen in the sample, and are broadcast.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything
if no row teaches; one language only gives it score 1; null languages teach nothing; repeated
rows count each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, quoted, utf8, whole
from .ftrl import Ftrl

BITS = 15
MAX_ROWS = 8_000
EPOCHS = 2
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the text's n-grams and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "uint32").astype("uint64")
    codes = np.where((codes < 97) | (codes > 122) & (codes < 128), np.uint64(32), codes)  # other ASCII is a space
    first, second, third = (codes * np.uint64(m) for m in _MULTIPLIERS)
    step = np.uint64(64 - BITS)
    two = first[:-1] ^ (second[1:] + np.uint64(2))
    three = two[:-1] * np.uint64(_MULTIPLIERS[1]) ^ third[2:]
    mixed = np.concatenate([third, two, three]) * np.uint64(_MULTIPLIERS[0])
    grams = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(_MULTIPLIERS[2]) >> step).astype("int64")
    if len(grams) < 4096:
        return np.unique(grams, return_counts=True)
    table = np.bincount(grams, minlength=1 << BITS)
    at = np.flatnonzero(table)
    return at, table[at]


def _frequencies(batches) -> Iterator:
    import pyarrow as pa

    seen, rows = np.zeros(1 << BITS, "int64"), 0
    for batch in batches:
        for text in utf8(batch.column("text")):
            seen[counts(text.decode())[0]] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], rows), pa.int64())], names=["at", "n"])


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and TF-IDF values, of length 1 in all."""
    at, n = counts(text)
    x = n * idf[at]
    length = np.sqrt((x * x).sum())
    return at, x / length if length else x


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _learn(idf_shared, epochs: int):
    def task(batches) -> Iterator:
        import pickle

        import pyarrow as pa

        idf = idf_shared.value
        rows = [(lang, order, text.decode()) for b in batches for lang, order, text in zip(b.column("lang").to_pylist(), b.column("order").to_pylist(), utf8(b.column("text")))]
        langs = sorted({lang for lang, _, _ in rows})
        number = {lang: i for i, lang in enumerate(langs)}
        bias = 1 << BITS
        model, aside = Ftrl(bias + 1, max(1, len(langs)), alpha=1.0, beta=1.0, l1=0.05, l2=0.05), []
        learning = []
        for i, (lang, _, text) in enumerate(rows):
            at, x = weighted(text, idf)
            row = (number[lang], np.append(at, bias), np.append(x, 1.0)[:, None])
            (aside if i % 5 == 4 else learning).append(row)
        if len(langs) > 1:
            for _ in range(epochs):
                for lang, at, x in learning:
                    w = model.weights(at)
                    error = softmax((w * x).sum(axis=0))
                    error[lang] -= 1
                    model.update(at, x * error, w)
        w = model.weights()
        best, temperature = None, 1.0
        if aside and len(langs) > 1:
            logits = np.array([(w[at] * x).sum(axis=0) for _, at, x in aside])
            truth = np.array([lang for lang, _, _ in aside])
            for t in np.geomspace(0.05, 20, 61):
                loss = -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
                if best is None or loss < best:
                    best, temperature = loss, float(t)
        kept = np.flatnonzero(np.abs(w).sum(axis=1))
        model_bytes = pickle.dumps({"langs": langs, "at": kept, "w": w[kept].astype("float32"), "temperature": temperature})
        yield pa.RecordBatch.from_arrays([pa.array([model_bytes], pa.binary())], names=["model"])

    return task


def train_langid(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> dict:
    """langs, at, w, temperature, idf: learned from rows of fold other than 2 of 4 with a language."""
    import pickle

    teaching = df.where((fold_of(key, 4) != 2) & quoted(lang).isNotNull()).select(quoted(key).alias("key"), whole(text).alias("text"), quoted(lang).cast("string").alias("lang"))
    seen = {r["at"]: r["n"] for r in teaching.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # at most 2**BITS + 1 rows
    rows = seen.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1 + rows) + 1)
    if seen:
        idf[np.fromiter(seen.keys(), "int64")] = np.log((1 + rows) / (1 + np.fromiter(seen.values(), "float64"))) + 1
    shared = df.sparkSession.sparkContext.broadcast(idf)
    # letters are looked for before the bound applies, keys only: the sample's texts are fetched by key
    order = F.xxhash64("key")
    cut = teaching.where(F.col("text").rlike(r"\p{L}")).select(order.alias("order")).orderBy("order").limit(max_rows).agg(F.max("order")).first()[0]
    sample = teaching.where(F.col("text").rlike(r"\p{L}") & (order <= F.lit(cut))).withColumn("order", order)
    # rows that share a key share its hash, so the bound is stated again
    sample = sample.select("text", "lang", "order").orderBy("order").limit(max_rows).coalesce(1).sortWithinPartitions("order", "lang", F.xxhash64("text"))
    got = sample.mapInArrow(_learn(shared, epochs), "model binary").first()
    return (pickle.loads(got["model"]) if got else {"langs": [], "at": np.zeros(0, "int64"), "w": np.zeros((0, 1), "float32"), "temperature": 1.0}) | {"idf": idf.astype("float32")}


def language(spark, model: dict):
    """A function from a text column to struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)
    ready: dict = {}

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        m = shared.value
        if "w" not in ready:
            ready["w"] = np.zeros(((1 << BITS) + 1, max(1, len(m["langs"]))), "float32")
            ready["w"][m["at"]] = m["w"]
        w, langs, scores = ready["w"], [], []
        for text in texts:
            if not text or not m["langs"] or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = weighted(text, m["idf"])
            p = softmax((x @ w[at] + w[-1]).astype("float64") / m["temperature"])
            best = int(p.argmax())
            langs.append(m["langs"][best])
            scores.append(float(p[best]))
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


def predict_language(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score."""
    rows = df.select(quoted(key).alias(key), (fold_of(key, 4) == 2).alias("held_out"), language(df.sparkSession, model)(whole(text)).alias("p"))
    return rows.select(key, "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def in_known_language(df: DataFrame, model: dict, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of `df` whose language is told with at least `min_score`, all columns as they were."""
    told = language(df.sparkSession, model)(whole(text))
    return df.where((told["lang"] != UNKNOWN) & (told["score"] >= min_score))
