import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.byte_bpe import PerfectHash, bpe_decode, bpe_encode, codec, merge, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return codec(PATH, PATTERN)


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = [b"k%d" % i for i in range(5000)]
    table = PerfectHash(keys)
    assert sorted(table.places) == list(range(5000))
    assert [table.place(k) for k in keys] == list(range(5000))
    assert all(table.place(b"no%d" % i) == -1 for i in range(2000))
    assert PerfectHash([]).n == 0


@given(text=st.text(max_size=60) | st.text(alphabet="ab '\n\t  \x1c\x85.,1é́", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text, oracle, own):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == oracle.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_merge_takes_the_leftmost_of_equal_pairs(oracle):
    ranks = read_ranks(PATH)
    for word in (b"aaaaaaa", b"thethethe", b"abababab", b"x", b"\xff\xfe\xfd"):
        assert b"".join(oracle.decode_single_token_bytes(i) for i in merge(ranks, word)) == word
    assert merge(ranks, b"aaaaaaa") == oracle._encode_single_piece(b"aaaaaaa")


def test_rows(spark, odd, oracle):
    rows = odd.where("length(text) < 1000 or text is null")
    got = sorted(map(tuple, bpe_encode(rows, PATH, PATTERN).collect()), key=repr)
    want = []
    for r in rows.collect():
        ids = np.array(oracle.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_long_words(odd):
    long = odd.where("length(text) > 1000")
    coded = bpe_encode(long, PATH, PATTERN, with_ids=True)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe_decode(coded, PATH, PATTERN).collect()}
    assert back == {r["doc_id"]: r["text"] for r in long.collect()}


def test_documents_and_empty(documents, texts, oracle, empty):
    got = bpe_encode(documents, PATH, PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(oracle.encode_ordinary(t)) for i, t in texts.items()}
    assert bpe_encode(empty, PATH, PATTERN).collect() == []
