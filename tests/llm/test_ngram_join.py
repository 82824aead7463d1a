import random
import re
from collections import defaultdict

import pytest

from plumbline.llm.ngram_join import components, ngram_components, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def _plain(rows, k=3, num=90):
    """(key, n, component) of every row, by comparing all pairs."""
    sets = [_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= num * max(len(a), len(b)) and 100 * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    return sorted(((key, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr)


def _near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, texts, k, num):
    rows = list(texts.items()) + [(1000 + i, t) for i, t in enumerate(_near_copies(150, 60, 4, 1))] + [(2000 + i, t) for i, t in enumerate(_near_copies(40, 400, 30, 2))]
    rows += [(3000 + i, f"short {i % 4} text"[: 5 + i]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for block in (128, 7):
        got = sorted(map(tuple, ngram_components(df, words=k, num=num, block=block).collect()), key=repr)
        assert got == _plain(rows, k, num)


def test_hot_shingles_in_a_grid(spark, monkeypatch):
    """A passage that many unlike texts share, and near copies of sizes around the threshold: cells of two groups."""
    monkeypatch.setattr("plumbline.llm.ngram_join.CUT", 2)
    rng = random.Random(3)
    shared = " ".join(f"p{i}" for i in range(30))
    texts = [f"{shared} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts += list(_near_copies(80, 40, 8, 5)) + [shared] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_components(df, words=3, num=80, block=5).collect()), key=repr) == _plain(rows, 3, 80)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, ngram_components(odd).collect()), key=repr) == _plain(rows)
    assert ngram_components(empty).collect() == []
    assert one_of_each(empty).collect() == []


def test_one_of_each_component_stays(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = one_of_each(odd)
    assert got.columns == odd.columns
    stays = sorted((r["doc_id"] for r in got.collect()), key=repr)
    # of the copies of "a b c d e" and its upper-case version the smallest key, one row of it
    assert stays.count(1) == 1 and 2 not in stays and 6 not in stays
    assert len(stays) == len({c for _, n, c in _plain(rows, 5, 80) if n}) + sum(not n for _, n, _ in _plain(rows, 5, 80))


def test_components_of_a_long_chain(spark):
    links = [(bytearray(b"%03d" % i), bytearray(b"%03d" % (i + 1))) for i in range(99)] + [(bytearray(b"a"), bytearray(b"a"))]
    got = components(spark.createDataFrame(links, "u binary, v binary")).collect()
    assert len(got) == 100 and {bytes(r["label"]) for r in got} == {b"000"}
    assert components(spark.createDataFrame([], "u binary, v binary")).collect() == []
