import hashlib
import random
import zlib

import pytest

from plumbline.llm.manifest import manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, extra=0):
    fields = [row[0], row[1], row[2], row[3] + extra if row[3] is not None else None, row[4]]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _beside(levels, at):
    for level in levels[:-1]:
        yield level[at ^ 1] if at ^ 1 < len(level) else "", at & 1
        at >>= 1


def _plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for v in langs}
    levels = {v: _levels([_leaf(r) for r in trees[v]]) for v in langs}
    top = _levels([levels[v][-1][0] for v in langs])
    out = []
    for i, v in enumerate(langs):
        for at, r in enumerate(trees[v]):
            way = [*_beside(levels[v], at), *_beside(top, i)]
            bad = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0
            node = _leaf(r, int(bad))
            for x, right in way:
                node = _h(x, node) if right else _h(node, x)
            root = top[-1][0]
            out.append((r[0], _leaf(r), levels[v][-1][0], root, _h(*[x for x, _ in way]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels,n", [(12, 90), (2, 90), (1, 37), (3, 1)])
def test_against_plain(spark, levels, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, n), rng.choice(["a", None, "é"]), rng.choice(["en", "en", "en", "de", None, "", "\uffee", "\U0001f600"]), rng.choice([None, 5, 99]), rng.choice([None, "", "some text", "é" * 50])) for _ in range(n)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", "solo", 1, "alone")] + [rows[0]] * 40  # equal subtrees
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert sorted(map(tuple, manifest(df, levels=levels).collect()), key=repr) == _plain(rows)


def test_odd_and_empty(odd, empty):
    cut = ["doc_id", "source", "lang", "n_chars", "text"]
    table = odd.selectExpr("*", "0 as n_chars", "1 as tree", "2 as rank", "3 as digest", "4 as size")
    rows = [tuple(r) for r in table.select(cut).collect()]
    assert sorted(map(tuple, manifest(table).collect()), key=repr) == _plain(rows)
    assert manifest(table.limit(0)).collect() == []
