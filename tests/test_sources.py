import csv as plain_csv
import io
import random
from datetime import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.session import scratch_dir
from plumbline.sources import (
    dataset_meta,
    load_rules,
    load_table,
    open_dataset,
    read_csv,
    read_table,
    read_xlsx,
    register_dataset,
    write_csv,
    write_parquet,
)
from plumbline.sources.delimited import field_count


@pytest.fixture
def csv(spark, tmp_path):
    def read(text, name="t.csv", **options):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8", newline="")
        return read_csv(spark, str(path), **options)

    return read


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_types_are_inferred(csv):
    df = csv("i,f,b,s,d,big,none\n1,1.5,True,x,2024-01-01,99999999999999999999,\n-2,3,false,y,2024-01-02,1,NA\n")
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "big": "string", "none": "double",
    }
    assert _rows(df)[1] == (-2, 3.0, False, "y", "2024-01-02", "1", None)


def test_missing_tokens(csv):
    df = csv('a,b,c\nNA,null,""\n1,x, keep \nNaN,n/a,#N/A\n')
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert _rows(df) == [(None, None, None), (1, "x", " keep "), (None, None, None)]


def test_java_number_forms_stay_text(csv):
    assert dict(csv("a,b,c\n1d,1_000,0x1F\n2,3,4\n").dtypes) == {"a": "string", "b": "string", "c": "string"}


def test_quotes_short_rows_blank_lines(csv):
    df = csv('a,b\n"say ""hi"", ok",1\n\nshort\n')
    assert _rows(df) == [('say "hi", ok', 1), ("short", None)]


def test_line_break_inside_quotes(csv):
    assert _rows(csv('a,b\n"two\nlines",1\n')) == [("two\nlines", 1)]
    assert _rows(csv('a,b\n"x ""\ny""",1\n', multi_line=True)) == [('x "\ny"', 1)]
    assert _rows(csv('a,b\n5" pipe,1\n6" pipe,2\n')) == [('5" pipe', 1), ('6" pipe', 2)]


def test_repeated_and_blank_headers(csv):
    assert csv("a,a,,a\n1,2,3,4\n").columns == ["a", "a.1", "Unnamed: 2", "a.2"]


def test_long_row_is_an_error(csv):
    with pytest.raises(Exception, match="more fields"):
        csv("a,b\n1,2\n3,4,5\n").collect()
    with pytest.raises(Exception, match="more fields"):
        csv("a,b\n1,2\n3,4,5\n", schema="a int, b int").count()


def test_empty_file_is_an_error(csv):
    with pytest.raises(ValueError):
        csv("")


def test_header_only(csv):
    df = csv("a,b\n")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_given_schema(csv):
    df = csv("a,b\n1,x\ny,2\n", schema="a int, b int")
    assert _rows(df) == [(1, None), (None, 2)]


def test_many_files_share_a_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"k,v\n{i},a{i}\n")
    assert sorted(_rows(read_csv(spark, str(tmp_path)))) == [(0, "a0"), (1, "a1"), (2, "a2")]


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _book(path, sheet, shared=None, styles=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            items = "".join(f"<si>{s}</si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_workbook(spark, tmp_path):
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="str"><v>ok</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>30</v></c><c r="C2" s="1"><v>45292.5</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="B4"><v>25</v></c><c r="D4" t="b"><v>0</v></c></row>'
    )
    shared = ["<t>name</t>", "<r><t>a</t></r><r><t>ge</t></r>", "<t>Alice</t>"]
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs>'
    _book(tmp_path / "a.xlsx", sheet, shared, styles)
    df = read_xlsx(spark, str(tmp_path))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "when": "timestamp_ntz", "ok": "boolean"}
    assert sorted(_rows(df), key=str) == [("Alice", 30, datetime(2024, 1, 1, 12), True), (None, 25, None, False)]


def test_workbooks_must_share_a_header(spark, tmp_path):
    _book(tmp_path / "a.xlsx", '<row r="1"><c r="A1" t="str"><v>x</v></c></row>')
    _book(tmp_path / "b.xlsx", '<row r="1"><c r="A1" t="str"><v>y</v></c></row>')
    with pytest.raises(ValueError):
        read_xlsx(spark, str(tmp_path))


def test_format_choice(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    (tmp_path / "t.upload").write_text("a\n1\n")
    _book(tmp_path / "t.xlsx", '<row r="1"><c r="A1" t="str"><v>a</v></c></row><row r="2"><c r="A2"><v>1</v></c></row>')
    (tmp_path / "t.bin").write_bytes((tmp_path / "t.xlsx").read_bytes())
    for name in ("t.csv", "t.upload", "t.xlsx"):
        assert _rows(read_table(spark, str(tmp_path / name))) == [(1,)]
    assert _rows(read_table(spark, str(tmp_path / "t.bin"), "xlsx")) == [(1,)]
    assert _rows(read_table(spark, str(tmp_path / "t.bin"))) == [(1,)]
    with pytest.raises(ValueError, match="xls"):
        read_table(spark, str(tmp_path / "t.xls"))


def test_damaged_workbook_is_an_error(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"not a zip")
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "a.xlsx")).collect()


def test_datasets(spark, people, tmp_path):
    register_dataset(people, "people_set", str(tmp_path / "people"))
    assert sorted(_rows(open_dataset(spark, "people_set"))) == sorted(_rows(people))
    with pytest.raises(KeyError):
        open_dataset(spark, "no_such_set")


def test_dataset_meta(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a" * 123)
    assert _rows(dataset_meta(spark, str(tmp_path))) == [("x.csv", 123)]


def test_sinks(spark, people, tmp_path):
    write_parquet(people, str(tmp_path / "p"))
    write_csv(people, str(tmp_path / "c"))
    assert sorted(_rows(spark.read.parquet(str(tmp_path / "p")))) == sorted(_rows(people))
    assert sorted(_rows(read_csv(spark, str(tmp_path / "c")))) == sorted(_rows(people))


def test_load_table_appends_and_counts(spark, people, tmp_path):
    for _ in range(2):
        assert load_table(people, "people_load", path=str(tmp_path / "w")) == {"success": True, "rows": 3}
    assert spark.table("PEOPLE_LOAD").count() == 6
    spark.sql("DROP TABLE PEOPLE_LOAD")


def test_rule_files(tmp_path):
    assert load_rules("rules/basic.yaml")["columns"]["age"] == {"type": "int", "min": 0, "max": 120}
    (tmp_path / "r.yaml").write_text("columns: {a: {unique: true}}")
    assert load_rules(tmp_path / "r.yaml") == {"columns": {"a": {"unique": True}}}
    with pytest.raises(FileNotFoundError):
        load_rules("nowhere.yaml")


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    if named:
        assert first.startswith(f"{named.rstrip('/')}/x-")


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,10\n")
    (tmp_path / "b.csv").write_text('y,x\n"20\n",2\n')
    (tmp_path / "c.csv").write_text("y,x\n30,3\n")
    df = read_csv(spark, str(tmp_path))
    assert sorted((r["x"], r["y"].strip()) for r in df.withColumn("y", df["y"].cast("string")).collect()) == [(1, "10"), (2, "20"), (3, "30")]
    (tmp_path / "d.csv").write_text("x,z\n1,1\n")
    with pytest.raises(ValueError, match="different columns"):
        read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("row", ["8,9,,LOST", "8,9,10", "8,9,", '8,"a,b",9'])
def test_any_extra_field_is_an_error(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text(f"x,y\n1,2\n{row}\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(tmp_path / "a.csv"), "x string, y string").collect()


def test_commas_in_quotes_and_short_rows_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,"a, ""b"", c",2\n3\n')
    assert _rows(read_csv(spark, str(tmp_path / "a.csv"))) == [(1, 'a, "b", c', 2), (3, None, None)]


def test_headers_that_differ_in_case_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,a,B\n1,2,3\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["A", "a.1", "B"] and _rows(df) == [(1, 2, 3)]


def test_java_numbers_are_no_numbers_under_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1d,1f,true\n2.5,7,maybe\n")
    assert _rows(read_csv(spark, str(tmp_path / "a.csv"), "x double, y int, z boolean")) == [(None, None, True), (2.5, 7, None)]


def test_workbook_rows_beyond_the_header_and_header_further_down(spark, tmp_path):
    sheet = (
        '<row r="3"><c r="A3" t="str"><v>x</v></c></row>'
        '<row r="4"><c r="A4"><v>1</v></c><c r="B4"><v>99</v></c></row><row r="6"><c r="A6"><v>2</v></c></row>'
    )
    _book(tmp_path / "a.xlsx", sheet)
    df = read_xlsx(spark, str(tmp_path))
    assert df.columns == ["x", "Unnamed: 1"] and sorted(_rows(df), key=str) == [(1, 99), (2, None)]


def test_workbook_of_1904_and_parts_of_a_second(spark, tmp_path):
    sheet = '<row r="1"><c r="A1" t="str"><v>t</v></c></row><row r="2"><c r="A2" s="1"><v>43830.00000578704</v></c></row>'
    _book(tmp_path / "a.xlsx", sheet, styles='<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs>')
    with zipfile.ZipFile(tmp_path / "a.xlsx", "a") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}"><workbookPr date1904="1"/></workbook>')
    assert _rows(read_xlsx(spark, str(tmp_path))) == [(datetime(2024, 1, 1, 0, 0, 0, 500000),)]


def test_content_decides_between_csv_and_workbook(spark, tmp_path):
    _book(tmp_path / "t.xlsx", '<row r="1"><c r="A1" t="str"><v>a</v></c></row><row r="2"><c r="A2"><v>1</v></c></row>')
    (tmp_path / "really_a_book.csv").write_bytes((tmp_path / "t.xlsx").read_bytes())
    assert _rows(read_table(spark, str(tmp_path / "really_a_book.csv"))) == [(1,)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("300", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_files_are_split_inside_quotes(spark, tmp_path, small_splits):
    """Random records against Python's csv: line breaks, doubled quotes, quotes that are letters, a record over many ranges."""
    rng, want = random.Random(1), []
    parts = ["a", "b", ",", '"', "\n", "\r\n", " ", "xyz", '""']
    for k in range(3):
        rows = [[f"{k}-{i}"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) + "." for _ in range(2)] for i in range(120)]
        rows[50][1] = "\n".join(f'line, "{j}"' for j in range(200))
        out = io.StringIO(newline="")
        writer = plain_csv.writer(out, lineterminator="\r\n" if k else "\n")
        writer.writerow(["id", "t", "u"])
        writer.writerows(rows)
        text = out.getvalue().replace(f"{k}-7,", f'{k}-7x"y,', 1)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        want += list(plain_csv.reader(io.StringIO(text, newline="")))[1:]
    df = read_csv(spark, str(tmp_path), schema="id string, t string, u string")
    assert sorted(map(list, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() > 20  # of three files


@pytest.mark.parametrize("record,fields", [('x"1,2"y,3', 3), ('"1,2",3', 2), ('"1,2"x,3', 2), ('"a""b,",c', 2), ("", 1), (",", 2), ('a,"b', 2), ('"' + 'x""' * 20_000 + '",b', 2)])
def test_fields_are_counted_as_they_are_read(spark, record, fields):
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(field_count(F.col("r"))).first()[0] == fields


def test_a_row_with_a_quote_inside_a_field_loses_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\nx"1,2"y,3\n')
    with pytest.raises(Exception, match="more fields than its header"):
        read_csv(spark, str(tmp_path), schema="a string, b string").collect()
    (tmp_path / "a.csv").write_text('a,b,c\nx"1,2"y,3\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), schema="a string, b string, c string").collect()] == [('x"1', '2"y', "3")]
