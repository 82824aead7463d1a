import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import WordTokenizer, best_fit, best_fit_packing, fillings, pack, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return WordTokenizer(PATH)


@given(texts=st.lists(st.text(max_size=40) | st.text(alphabet="aB'sé́İ.!,#<|> \n  \x1c9", max_size=40), max_size=4))
@settings(max_examples=200, deadline=None)
def test_words_give_what_whole_texts_give(texts, oracle, own):
    got = [np.frombuffer(b, "<u4").tolist() for b in own.encode([t.encode() for t in texts])]
    assert got == [oracle(t) for t in texts]


def test_letters_and_forgetting(oracle, own, monkeypatch):
    """Runs of letters skip all but the merging; words come and go through both generations."""
    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = ["".join(letters[i : i + 3]) + " x" + letters[i].upper() + "y" + letters[i] + "\u0301" for i in range(len(letters))]
    texts += ["İstanbul I\u0307x ŉ ǰ J\u030c ß SS ẞ ſ K", "don't WE'LL it'S", "Éa ÉA éa", "日本 ひ かﾞ ㍿", "aª º µ"]
    monkeypatch.setattr("plumbline.llm.packing.MEMO", 50)
    for round_ in range(2):
        for text in texts:
            assert [np.frombuffer(b, "<u4").tolist() for b in own.encode([text.encode()])] == [oracle(text)], text


def _check(rows, df, oracle, capacity=2048):
    got = best_fit_packing(df, PATH, capacity=capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = oracle(t or "") + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n * k[3] for k, n in want.items())
    return len(by), -(-total // capacity)


def test_odd_rows(odd, oracle):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _check(rows, odd, oracle)
    _check(rows, odd.repartition(5), oracle, capacity=16)


def test_documents_fill_the_least_sequences(documents, texts, oracle):
    used, least = _check(texts.items(), documents, oracle)
    assert used <= least + 1


def test_empty(empty):
    assert best_fit_packing(empty, PATH).collect() == []


def test_sequences_hold_the_ids(documents, texts, oracle):
    few = documents.where("doc_id < 20")
    got = sequences(best_fit_packing(few, PATH, with_ids=True)).collect()
    ids = sorted(i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == sorted(i for d, t in texts.items() if d < 20 for i in oracle(t) + [0])


def _least_bins(items, capacity):
    """Exact, for a handful of items."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            go(i + 1, bins[:j] + [room - items[i]] + bins[j + 1 :])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best


def _uses(plan):
    used = Counter()
    for pattern, times in plan:
        for length, k in pattern:
            used[length] += k * times
    return used


def test_small_cases_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        plan = pack(Counter(items), 20)
        assert _uses(plan) == Counter(items)
        assert sum(times for _, times in plan) == _least_bins(items, 20)


def test_plans_place_all_and_beat_or_match_best_fit():
    rng = random.Random(2)
    for _ in range(5):
        counts = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)}
        plan, incumbent = pack(counts, 100, nodes=500), best_fit(counts, 100)
        assert _uses(plan) == _uses(incumbent) == Counter(counts)
        assert all(sum(x * k for x, k in p) <= 100 for p, _ in plan)
        assert sum(t for _, t in plan) <= sum(t for _, t in incumbent)
        assert len(plan) <= 200


def test_fillings_are_undominated():
    lengths = [3, 4, 5, 7]
    counts = dict.fromkeys(lengths, 1)
    got = {tuple(sorted(f)) for _, f in fillings(8, counts, lengths)}
    every = {c for n in range(4) for c in combinations(lengths, n) if sum(c) <= 8}
    assert (3, 5) in got and got <= every and (4,) not in got and (3,) not in got
