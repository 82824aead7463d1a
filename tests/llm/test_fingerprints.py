import hashlib
import random
from collections import Counter
from unittest.mock import patch

import pytest

from plumbline.llm.common import stored
from plumbline.llm.fingerprints import ANCHORS, edited_fingerprints, fingerprint, signatures, signed_rows, spot_classes
from pyspark.sql import functions as F


def _chains(words):
    """Anchor and the two content words after it, as the paper defines them."""
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in ANCHORS][:2]
        if w in ANCHORS and len(content) == 2:
            out.add(" ".join([w, *content]))
    return out


def test_chains(spark):
    texts = ["The cat sat on the mat of a big red dog and it was that", "is the of a", "no anchors here", "the the x the y", "", "A B. the c d", "the e", "the " * 30_000 + "x y", "word the " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", signatures(F.col("text")).alias("s")).collect():
        words = r["text"].lower().replace(".", " ").split()
        want = _chains(words) or ({" " + " ".join(words) + " "} if words else set())
        hashed = spark.createDataFrame([(c,) for c in want], "c string").select(F.xxhash64("c")).collect() if want else []
        assert set(r["s"]) == {h[0] for h in hashed}, r["text"]


def _compare(df, rows):
    got = edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    nexts = {}
    for i, (k, t) in enumerate(order):
        nexts.setdefault(k, set()).add((t or "", order[(i + 1) % len(order)][1] or ""))
    for r in got:
        want = set()
        for t, n in nexts[r["doc_id"]]:
            half = len(t) // 2
            want.add((len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
        assert (r["n_chars"], r["edited_sha256"]) in want
        a, b = set(r["fingerprint"].split()), set(r["edited_fingerprint"].split())
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    return got


def test_documents(documents, texts):
    got = _compare(documents.repartition(5), list(texts.items()))
    sets = {r["doc_id"]: set(r["fingerprint"].split()) for r in got}
    order = sorted(sets, reverse=True)
    for r in got:
        a, b = sets[r["doc_id"]], sets[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        assert r["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, sets[i]) == sets[i]


def test_few_rows(spark):
    for n in (1, 2, 3):
        rows = [(i, f"the text number {i} of a few") for i in range(n)]
        _compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_odd_rows(odd, empty):
    got = edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert edited_fingerprints(empty).collect() == []
    _compare(odd.where("doc_id is not null and doc_id > 2"), [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] and r["doc_id"] > 2])


def _plain_classes(rows, sets):
    """Smallest key reachable by links, from all pairs."""
    names = sorted(set(sets.values()), key=sorted)
    top = {s: s for s in names}

    def find(s):
        while top[s] != s:
            s = top[s]
        return s

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a and b and len(a & b) / len(a | b) >= 0.8:
                top[find(a)] = find(b)
    least = {}
    for k, t in rows:
        s = find(sets[t])
        least[s] = k if least.get(s) is None else least[s] if k is None else min(k, least[s])
    return {(k, t): least[find(sets[t])] for k, t in rows}


def _same_classes(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    prints = df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select("text", fingerprint(signatures(F.col("text"))).alias("f")).collect()
    want = _plain_classes(rows, {r["text"]: frozenset(r["f"].split()) for r in prints})
    got = {(r["key"], r["tie"]): r["class_id"] for r in spot_classes(signed_rows(df)).collect()}
    assert got == {(k, hashlib.sha1(t.encode()).hexdigest()): c for (k, t), c in want.items()}
    return want


def _edited(rng, words, many):
    words = list(words)
    for _ in range(many):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
    return " ".join(words)


def test_classes_are_components_of_all_links(spark, documents):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" if i % 3 else "the" for i in range(240)]
    rows = [(i + 10**6, _edited(rng, base if i % 2 else base[:200], i // 6)) for i in range(60)]
    # a chain: each step is near the one before, the ends are not near each other
    step = base
    for i in range(12):
        step = _edited(rng, step, 4).split()
        rows.append((i + 2 * 10**6, " ".join(step)))
    want = _same_classes(documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    sizes = Counter(want.values())
    assert 20 < max(sizes.values()) < len(rows) and len(sizes) > 20


def test_classes_of_random_short_texts(spark):
    rng = random.Random(3)
    words = ["the", "a", "cat", "dog", "sat", "mat"]
    rows = [(rng.randint(0, 500), " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 12, 13, 14, 30])))) for _ in range(150)]
    _same_classes(spark.createDataFrame(rows, "doc_id long, text string"))


def test_classes_of_odd_rows(odd, empty):
    want = _same_classes(odd)
    classes = Counter((r["doc_id"], r["class_id"]) for r in edited_fingerprints(odd).collect())
    assert classes == Counter((r["doc_id"], want[r["doc_id"], r["text"] or ""]) for r in odd.collect())
    assert spot_classes(signed_rows(empty)).collect() == []


def test_no_pairs_within_a_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" if i % 3 else "the" for i in range(300)]
    df = spark.createDataFrame([(i, _edited(rng, base, 3)) for i in range(1500)], "doc_id long, text string")
    made = {}

    def noted(rows, label):
        out = stored(rows, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    with patch("plumbline.llm.fingerprints.stored", noted):
        assert {r["class_id"] for r in spot_classes(signed_rows(df)).collect()} == {0}
    assert made["spots-star"] <= made["spots-bins"] * 2 and made["spots-pairs"] < 20 * 1500  # 1,124,250 pairs of classes


def test_a_large_group_of_near_copies_is_not_paired(spark, monkeypatch):
    """Its ends alone do not hold it together: members are as far from each other as the threshold allows."""
    import random

    from plumbline.llm import fingerprints as module

    rng = random.Random(3)
    base = [f"{'the ' if i % 2 else ''}w{i}" for i in range(120)]
    texts = []
    for _ in range(250):
        own = list(base)
        for i in rng.sample(range(1, 120, 6), rng.randint(1, 5)):
            own[i] = f"the x{rng.randint(0, 30)}"
        texts.append(" ".join(own))
    made, verified = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    signed = module.signed_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = {r["key"]: set(r["sigs"]) for r in signed.collect()}
    got = {r["key"]: r["class_id"] for r in module.spot_classes(signed).collect()}
    want = {k: k for k in sets}
    for _ in range(len(sets)):
        new = {k: min(want[j] for j, other in sets.items() if len(own & other) >= 0.8 * len(own | other)) for k, own in sets.items()}
        if new == want:
            break
        want = new
    assert got == want
    assert made[-1] < len(texts) and sum(made) < 250 * 249 / 8  # the last step pairs what is left


def test_stored_tables_do_not_outlive_their_use(spark):
    """Only what the returned classes still read stays on the shared disk, besides the links: ids and labels."""
    import os
    from urllib.parse import urlparse

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" if i % 3 else "the" for i in range(120)]
    rows = [(i, _edited(rng, base, 2) if i % 2 else f"the own{i} text{i} of many{i} words{i}") for i in range(60)]
    made = []

    def noted(df, label):
        out = stored(df, label)
        made.append((label, os.path.dirname(urlparse(out.inputFiles()[0]).path)))
        return out

    with patch("plumbline.llm.fingerprints.stored", noted):
        classes = spot_classes(signed_rows(spark.createDataFrame(rows, "doc_id long, text string")))
    left = {label for label, folder in made if os.path.isdir(folder)}
    assert {"spots-signed", "spots-least"} <= left <= {"spots-signed", "spots-least", "spots-links"}
    assert {r["key"]: r["class_id"] for r in classes.collect()} == {i: 1 if i % 2 else i for i, _ in rows}
