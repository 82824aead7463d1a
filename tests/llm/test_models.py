import zlib

import numpy as np

from plumbline.llm.ftrl import Ftrl
from plumbline.llm.langid import in_known_language, predict_language, train_langid
from plumbline.llm.toxicity import features, score_toxicity, train_toxicity, without_toxic


def _held(key, parts=4):
    return zlib.crc32(("" if key is None else str(key)).encode()) % parts == 2


def test_ftrl_matches_the_published_update():
    model = Ftrl(2, 1, alpha=0.5, beta=1.0, l1=0.3, l2=0.2)
    z = n = w = 0.0
    for g in (1.0, -0.4, 0.7, 0.2, 0.9):
        w = 0.0 if abs(z) <= 0.3 else -(z - np.sign(z) * 0.3) / ((1 + np.sqrt(n)) / 0.5 + 0.2)
        at = np.array([1])
        now = model.weights(at)
        assert np.isclose(now[0, 0], w)
        model.update(at, np.array([[g]]), now)
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
        n += g * g
    assert model.weights()[0, 0] == 0


def test_features_are_words_pairs_and_skips():
    assert len(features("one two three")) == 3 + 2 + 1
    assert len(features("one one one")) == 1 + 1 + 1
    assert len(features("")) == 0
    assert len(np.intersect1d(features("a b x"), features("A, b!! y"))) == 3


def _sample(spark, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, 30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[5] = words[20] = "scoundrel"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_is_learned_and_sparse(spark):
    df, labels, truth = _sample(spark)
    weights = train_toxicity(df, labels)
    got = score_toxicity(df, weights).collect()
    assert len(weights) < 2000
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: _held(i) for i in truth}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = without_toxic(df, weights)
    assert kept.columns == df.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    df, labels, truth = _sample(spark)
    flipped = spark.createDataFrame([(i, t if not _held(i) else 1 - t) for i, t in truth.items()], "doc_id long, toxic int")
    assert train_toxicity(df, labels) == train_toxicity(df.repartition(3), flipped)


def test_toxicity_of_odd_rows(spark, odd, empty):
    df, labels, _ = _sample(spark)
    weights = train_toxicity(df, labels)
    got = score_toxicity(odd, weights).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(empty, weights).collect() == []
    assert without_toxic(odd, weights).columns == odd.columns
    nothing = train_toxicity(empty, labels.limit(0))
    assert nothing == {} and all(r["score"] == 0 for r in score_toxicity(odd, nothing).collect())
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    train_toxicity(odd, odd_labels)


def test_languages_on_held_out_documents(spark, documents):
    model = train_langid(documents)
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = predict_language(documents, model).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    # calibrated: mean score close to accuracy
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held])) < 0.08
    hidden = documents.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang", "lang as source")
    again = train_langid(hidden)
    assert again["langs"] == model["langs"] and np.array_equal(again["w"], model["w"])


def test_language_of_odd_rows(odd, empty, documents):
    model = train_langid(documents)
    got = {(r["doc_id"], r["lang_pred"]) for r in predict_language(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und"), (None, "und")} <= got
    assert len(predict_language(odd, model).collect()) == odd.count()
    kept = in_known_language(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 9} & {r["doc_id"] for r in kept.collect()}
    assert predict_language(empty, model).collect() == []
    train_langid(odd)
    nothing = train_langid(empty)
    assert {r["lang_pred"] for r in predict_language(odd, nothing).collect()} == {"und"}
