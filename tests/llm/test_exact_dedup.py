import hashlib
from collections import defaultdict

import pytest

from plumbline.llm.exact_dedup import ContentTable, exact_dedup, without_copies


def _check(df, rows, **limits):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup(df, **limits).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = texts[r["text_sha256"]]
        best = max((i for i in groups[t] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(groups[t]))
        assert not r["kept"] or r["doc_id"] == best
        kept[t] += r["kept"]
    assert all(kept[t] == 1 for t in groups)


def test_odd_rows(odd):
    _check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("limits", [{"run_bytes": 2000}, {"run_bytes": 500, "bucket_bytes": 300}, {"run_bytes": 100, "fan_in": 2, "bucket_bytes": 1000}])
def test_many_runs_and_buckets(spark, limits):
    rows = [(i, f"text {i % 7}" if i % 3 else f"only {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    _check(df, rows, **limits)


def test_empty(empty):
    assert exact_dedup(empty).collect() == []
    assert without_copies(empty).collect() == []


def test_rows_that_stay_are_whole(odd):
    got = without_copies(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert {r["text"] for r in rows if r["text"]} == {r["text"] for r in odd.collect() if r["text"]}
    assert sum(not r["text"] for r in rows) == 1
    assert [r["doc_id"] for r in rows if r["text"] == "a b c d e"] == [2]


def test_table_compares_content_of_equal_hashes():
    table = ContentTable()
    contents = [b"%d" % i for i in range(3000)]
    assert [table.entry(i % 3, c) for i, c in enumerate(contents)] == list(range(3000))
    assert [table.entry(i % 3, c) for i, c in enumerate(contents)] == list(range(3000))
