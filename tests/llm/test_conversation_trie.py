import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm.conversation_trie import Parentheses, conversation_trie


def _plain(rows, block=20, folds=4):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), x))
    built = {}
    for c, own in convs.items():
        own.sort()
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % folds
        built[c] = [(x[2], x[4]) for x in convs.get(c - int(np.fmod(c, block)), [])[:h] + own[h:]]
    nodes, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * words
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1 << 18, 12, 1])
def test_against_plain(spark, shard):
    rng = random.Random(4)
    texts = ["", None, "one", "two words", "and three words", " \t", "x\u00a0y z"]
    rows = []
    for c in range(-45, 200):
        for t in range(rng.choice([0, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(texts)))
    for c in range(500, 700):  # copies, and others that go on from them
        rows += [(c, t, "user", f"turn {t}") for t in range(5 + c % 3)]
    rows += [(900, t, "user", f"long {t % 3}") for t in range(600)] + [(None, 0, "user", "nobody")] + [rows[0]] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert sorted(map(tuple, conversation_trie(df, shard=shard).collect()), key=repr) == _plain(rows)


def test_odd_names_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "u", "a b", 5, "x"), (2, None, None, None, 6, "y")], "conv_id long, turn long, role string, text string, node int, seq string")
    assert sorted(map(tuple, conversation_trie(df).collect()), key=repr) == _plain([tuple(r)[:4] for r in df.collect()])
    assert conversation_trie(df.limit(0)).collect() == []


def test_findclose():
    rng, bits, depth = random.Random(1), [1], 1
    while depth:
        up = len(bits) < 6000 and rng.random() < 0.55 or depth == 1 and len(bits) < 6000
        bits.append(int(up))
        depth += 1 if up else -1
    tree, stack = Parentheses(np.array(bits, "uint8")), []
    for i, bit in enumerate(bits):
        if bit:
            stack.append(i)
        else:
            assert tree.findclose(stack.pop()) == i
    assert tree.leaves(0, len(bits) - 1) == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))
