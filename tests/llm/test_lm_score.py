import math
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm.lm_score import LEAST_CHANCE, MIN_COUNT, RATIO, STRENGTH, SuffixTree, build_tree, lm_score, symbols
from plumbline.llm.queries import QUERIES


def _fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def _tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def _check(df, rows):
    learned = Counter(w for k, t in rows if not _fold(k) for w in _tokens(t))
    n, v = sum(learned.values()), len(learned)
    want = []
    for k, t in rows:
        ws = _tokens(t)
        base = sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((k, _fold(k), len(ws), sum(learned[w] > 0 for w in ws), n, round(base, 6)))
    got = lm_score(df).collect()
    plain = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    for a, b in zip(sorted(plain, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=2e-6)
    assert len(plain) == len(want)
    return got, learned


def test_odd_rows(odd, empty):
    got, _ = _check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(r["score"] < 0 for r in got)
    assert lm_score(empty).collect() == []


def test_nothing_to_learn_from(spark):
    held = [i for i in range(50) if _fold(i)][:3]
    got, _ = _check(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"), [(i, "a b") for i in held])
    assert all(math.isfinite(r["score"]) for r in got)


def test_scores_are_those_of_the_tree_read_in_one_place(spark, documents, texts):
    got, learned = _check(documents.repartition(4), list(texts.items()))
    tree = build_tree(spark.createDataFrame([(bytearray(w), n) for w, n in learned.items()], "word binary, n long"))
    n, v = sum(learned.values()), len(learned)
    for r in got[:40]:
        want = sum(math.log10((learned[w] + v * 10 ** tree.word(w.decode())) / (n + v)) for w in _tokens(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def _plain_tree(counts, depth, min_share, ratio):
    """The kept contexts, by definition."""
    pairs = Counter()
    for word, n in counts.items():
        line = symbols(word)
        for i in range(1, len(line)):
            for k in range(max(0, i - depth), i + 1):
                pairs[line[k:i], line[i]] += n
    totals = Counter()
    for (c, _), n in pairs.items():
        totals[c] += n
    least = min_share * totals[""]
    candidates = {c for c, n in totals.items() if n >= least}
    p = {(c, s): n / totals[c] for (c, s), n in pairs.items() if c in candidates and n >= least / 16}
    kept = {""}
    for (c, s), x in p.items():
        if c and (c[1:], s) in p and x >= 1e-3 and (x / p[c[1:], s] >= ratio or x / p[c[1:], s] <= 1 / ratio):
            kept |= {c[i:] for i in range(len(c))}
    return kept


def test_divergence_test_keeps_what_the_definition_keeps(spark):
    counts = {"abab": 50, "abba": 9, "cabab": 30, "dab": 5, "été": 7, "": 20}
    df = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in counts.items()], "word binary, n long")
    for depth, share, ratio in ((3, 0.01, 1.1), (2, 0.05, 1.5), (5, 0.001, 1.05)):
        assert set(build_tree(df, depth, share, ratio).chances) == _plain_tree(counts, depth, share, ratio)


def test_chances_after_a_context_sum_to_one():
    nodes = {"": ({"a": 6, "b": 3}, 10, 3), "a": ({"b": 4}, 5, 2), "ba": ({"a": 1, "b": 2}, 3, 2)}
    tree = SuffixTree(nodes, 3)
    for context in ("", "a", "ba", "cba", "c"):
        seen = sum(10 ** tree.chance(context, s) for s in "ab")
        rest = (2**21 - 2) * 10 ** tree.chance(context, "z")
        assert seen + rest == pytest.approx(1.0, rel=1e-9)
    assert tree.state("cba") == "ba" and tree.state("c") == ""


def _plain_words(rows, words, tree):
    """The scores by a tree of whole words, by definition; log10, one per row."""
    lines = [[b"", *_tokens(t)] for _, t in rows]  # the first end is the document's start
    learned = [not _fold(k) for k, _ in rows]
    counts = Counter(w for line, of in zip(lines, learned) if of for w in line[1:])
    n, v = sum(counts.values()), len(counts)
    after = {}
    for line, of in zip(lines, learned):
        for i in range(1, len(line) if of else 0):
            for k in range(1, min(i, words) + 1):
                after.setdefault(tuple(line[i - k : i]), Counter())[line[i]] += 1
    after = {c: x for c, x in after.items() if sum(x.values()) >= MIN_COUNT}
    kept = set()
    for c, x in after.items():
        shorter = after[c[1:]] if len(c) > 1 else counts
        for w, m in x.items():
            p, q = m / sum(x.values()), shorter[w] / sum(shorter.values())
            if p >= LEAST_CHANCE and (p / q >= RATIO or p / q <= 1 / RATIO):
                kept |= {c[i:] for i in range(len(c))}
    scores = []
    for line in lines:
        total = 0.0
        for i in range(1, len(line)):
            q = tree.word(line[i].decode())
            p = counts[line[i]] / (n + v) + v / (n + v) * 10**q if counts[line[i]] else 0.0
            log = math.log10(p) if p else math.log10(v / (n + v)) + q
            for k in range(1, min(i, words) + 1):
                c = tuple(line[i - k : i])
                if c in kept:
                    m, all_ = after[c][line[i]], sum(after[c].values()) + STRENGTH
                    log = math.log10(m / all_ + STRENGTH / all_ * 10**log) if m else math.log10(STRENGTH / all_) + log
            total += log
        scores.append(total)
    return scores, kept, after


def _tree_of(spark, rows):
    counts = Counter(w for k, t in rows if not _fold(k) for w in _tokens(t))
    return build_tree(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"))


@pytest.mark.parametrize("words", [1, 2, 3])
def test_contexts_of_earlier_words(spark, documents, texts, words):
    rows = list(texts.items())
    want, kept, _ = _plain_words(rows, words, _tree_of(spark, rows))
    assert {len(c) for c in kept} == set(range(1, words + 1))
    got = lm_score(documents.repartition(4), words=words).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({k: x for (k, _), x in zip(rows, want)}, rel=1e-9)


def test_contexts_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, _, _ = _plain_words(rows, 2, _tree_of(spark, rows))
    got = lm_score(odd, words=2).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), rel=1e-9)
    assert lm_score(empty, words=2).collect() == []


def test_contexts_that_tell_no_more_than_their_suffix(spark):
    rows = [(i, "a b " * 40 + "c" * (i % 3)) for i in range(8)] + [(9, "b a a c"), (None, "b b a"), (None, None)]
    want, kept, after = _plain_words(rows, 2, _tree_of(spark, rows))
    assert (b"a",) in kept and (b"b", b"a") in set(after) - kept
    got = lm_score(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), rel=1e-9)


def test_the_query_tells_a_text_from_its_words_in_another_order(spark, tmp_path):
    learned = [i for i in range(200) if not _fold(i)][:60]
    held = [i for i in range(300, 400) if _fold(i)][:3]
    said = "the red fox ran over a hill and saw the sea"
    rows = [(i, said) for i in learned] + list(zip(held, (said, "sea hill the fox a and over saw red ran the", said.upper())))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in QUERIES["op5_lm_score"](spark, str(tmp_path)).collect()}
    assert score[held[0]] == pytest.approx(score[held[2]], rel=1e-12)
    assert score[held[0]] > score[held[1]] + 3
