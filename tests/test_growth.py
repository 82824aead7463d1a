"""What the plans of single queries must not do on larger tables, and that odd rows give what they gave."""

import contextlib
import io

import pytest

import __spark_entry__ as contract

PLANS = contract.queries()


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "lines, orders, known",
    [
        (range(2000), range(2000), True),
        (range(2000), range(7), False),
        ([*range(2000), *[None] * 500], range(2000), True),  # null is not told to be missing
        (range(2000), [*range(7), None], True),  # nor is any key beside a null
        (range(2000), [], False),
        ([None] * 2000, [], False),  # but nothing is in an empty list
        ([5] * 2000, [5] * 300, True),
    ],
)
def test_a_sample_is_checked_without_broadcasting_the_other_table(spark, tmp_path, lines, orders, known):
    sf = _tables(spark, tmp_path, lineitem=([(i,) for i in lines], "l_orderkey long"), orders=([(i,) for i in orders], "o_orderkey long"))
    df = PLANS["sql_sample_checked"](spark, sf)
    assert "Broadcast" not in _plan(df)
    assert df.first()["all_known"] is known


def test_an_estimate_keeps_no_sketch_per_distinct_value(spark, tmp_path):
    rows = [(i % 300, i % 7) for i in range(1000)] + [(None, None)] * 5
    df = PLANS["sql_approx_distinct"](spark, _tables(spark, tmp_path, lineitem=(rows, "l_partkey long, l_orderkey long")))
    assert "Expand" not in _plan(df)
    assert tuple(df.first()) == (300, 7, True, True)


def test_workbooks_reach_python_one_by_one(spark):
    """However many a partition has."""
    import io as files
    import zipfile

    from plumbline.sources import workbook

    content = files.BytesIO()
    with zipfile.ZipFile(content, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c t="inlineStr"><is><t>a</t></is></c></row><row r="2"><c><v>5</v></c></row></sheetData></worksheet>')
    books = spark.createDataFrame([(f"book-{i}", bytearray(content.getvalue())) for i in range(30)], "path string, content binary").coalesce(1)
    assert "MapInPandas" not in _plan(workbook.decode_workbooks(books))
    assert sorted(map(tuple, workbook.decode_workbooks(books).collect())) == sorted((f"book-{i}", *row) for i in range(30) for row in ((1, ["a"]), (2, ["5"])))
