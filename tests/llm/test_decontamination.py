import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm.decontamination import decontaminate, near, phrase_starts, proximity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _plain(docs, items, size=10, span=12):
    windows = [(i, tuple(w[at : at + size])) for i, t in items if (w := _words(t)) for at in range(max(1, len(w) - size + 1))]
    out = []
    for key, text in docs:
        ws = _words(text)
        hit, found, close = set(), set(), set()
        for item, window in windows:
            for at in range(len(ws) - len(window) + 1):
                if tuple(ws[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
            if any(set(window) <= set(ws[at : at + span]) for at in range(len(ws))):
                close.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((key, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), len(close - {None})))
    return sorted(out, key=repr)


def _texts(rng, vocabulary, n, longest):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("segment,block", [(1 << 22, 1 << 15), (60, 5)])
def test_against_plain(spark, segment, block):
    rng = random.Random(segment)
    few, many = list("abcde"), [f"w{i}" for i in range(300)]
    items = list(enumerate(_texts(rng, many, 12, 25) + _texts(rng, few, 6, 12) + ["", None, "the THE the", "solo"]))
    items += [(None, "nameless item of words that occurs"), (3, items[3][1]), (3, "a second text under the same id")]
    docs = _texts(rng, many, 30, 60) + _texts(rng, few, 10, 30) + ["", None, "... !", "the the the the", "Solo! nameless item of words that occurs"]
    for _, text in items[:12]:
        words = (text or "").split()
        docs.append(" ".join(rng.choice(many) for _ in range(5)) + " " + text.upper() + ", " + " ".join(words[::-1]))
        if len(words) > 10:  # one word put between: a proximity match only
            docs.append(" ".join(words[:4] + ["between"] + words[4:10]))
    docs += [docs[-1]] * 40
    rows = list(enumerate(docs)) + [(None, docs[-1]), (0, docs[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(df, table, segment_words=segment, block=block)
    want = _plain(rows, items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[-1] > w[3] for w in want) and any(w[3] for w in want)


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e"), (2, "word " * 12), (3, "zebra")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, decontaminate(odd, items).collect()), key=repr) == _plain(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert decontaminate(empty, items).count() == 0
    none = decontaminate(odd, items.limit(0))
    assert none.where("contaminated or n_items > 0 or n_near > 0").isEmpty() and none.count() == odd.count()


def test_lists():
    starts = np.array([0, 10, 20])
    a, b = np.array([2, 9, 15]), np.array([3, 10, 18])
    assert near([a, b], 2).tolist() == [2, 9]
    assert phrase_starts(near([a, b], 2), 0, [(1, b)], starts, 2).tolist() == [2]  # 9 and 10 are in two documents
    assert proximity(np.array([2, 9, 15]), [b], starts, 4).tolist() == [2, 15]
