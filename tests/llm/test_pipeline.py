"""The pipeline's rows against a plain reading of its stages, each on the rows that the plain stage before kept."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_ngram_join import _plain as near_copies
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.langid import predict_language, train_langid
from plumbline.llm.toxicity import score_toxicity, train_toxicity


def test_run_equals_plain_stages(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    toxic = {r["doc_id"] for r in score_toxicity(documents, train_toxicity(documents, labels)).where("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i not in toxic}
    # language ID learns from what is left
    left = documents.where(~documents["doc_id"].isin(list(toxic)))
    told = {r["doc_id"]: r for r in predict_language(left, train_langid(left)).collect()}
    rows = {i: t for i, t in rows.items() if told[i]["lang_pred"] != "und" and told[i]["score"] >= 0.5}
    last = {}
    for i, t in sorted(rows.items()):
        last[t] = i
    rows = {i: t for t, i in last.items()}
    component = {key: c for key, n, c in near_copies(list(rows.items()), 5, 80)}
    rows = {i: t for i, t in rows.items() if component[i] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokenizer.encode_special_tokens = True
    want = set()
    for i, t in rows.items():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, piece, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for piece, at in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert 0 < len(toxic) and len(rows) < documents.count() - len(toxic)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for filled in places.values():
        ends = [0]
        for offset, length in sorted(filled):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(places) >= -(-sum(r["length"] for r in got) // 2048)
