"""Source and sink queries: write with the sink, read back with the source, compare."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators.clean import clean
from ..session import scratch_dir
from ..sources import (
    load_table,
    read_table,
    open_dataset,
    read_csv,
    read_workbooks,
    register_dataset,
    rows_per_file,
    write_csv,
    write_parquet,
)
from .derived import WITH_DIRTY, dirty
from .registry import plan, table

CUSTOMER_SQL = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"


@plan("scan_csv", CUSTOMER_SQL)
def scan_csv(spark, sf_dir):
    path = scratch_dir(spark, "scan_csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return read_csv(spark, path)


@plan("scan_csv_text", "select conv_id, turn, role, text from conversations")
def scan_csv_text(spark, sf_dir):
    """Whole texts with quotes and line breaks."""
    path = scratch_dir(spark, "scan_csv_text")
    write_csv(table(spark, sf_dir, "conversations"), path)
    return read_csv(spark, path)


@plan("scan_csv_multiline", "select doc_id, text, lang, source, n_chars from documents")
def scan_csv_multiline(spark, sf_dir):
    """Documents with their line breaks; files are split inside quotes."""
    path = scratch_dir(spark, "scan_csv_multiline")
    write_csv(table(spark, sf_dir, "documents"), path)
    return read_csv(spark, path)


TOKENS = {
    "c_custkey": "c_custkey",
    "whole": "case when c_custkey % 7 = 0 then 'NA' when c_custkey % 5 = 0 then 'null' else cast(c_nationkey as string) end",
    "part": "case when c_custkey % 3 = 0 then 'n/a' when c_custkey % 4 = 0 then '#N/A' else cast(c_acctbal as string) end",
    "flag": "case when c_custkey % 2 = 0 then 'True' when c_custkey % 9 = 0 then 'NaN' else 'False' end",
    "word": "case when c_custkey % 8 = 0 then 'None' else c_mktsegment end",
    "mixed": "case when c_custkey % 6 = 0 then 'unknown' else cast(c_nationkey as string) end",
}


@plan(
    "scan_csv_na_tokens",
    "select c_custkey, case when c_custkey % 7 <> 0 and c_custkey % 5 <> 0 then cast(c_nationkey as bigint) end as whole, "
    "case when c_custkey % 3 <> 0 and c_custkey % 4 <> 0 then c_acctbal end as part, "
    "case when c_custkey % 2 = 0 then true when c_custkey % 9 <> 0 then false end as flag, "
    "case when c_custkey % 8 <> 0 then c_mktsegment end as word, "
    "case when c_custkey % 6 = 0 then 'unknown' else cast(c_nationkey as varchar) end as mixed from customer",
)
def scan_csv_na_tokens(spark, sf_dir):
    path = scratch_dir(spark, "scan_csv_na")
    write_csv(table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in TOKENS.items()]), path)
    return read_csv(spark, path)


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


_STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
_BOOK_1904 = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><workbookPr date1904="1"/></workbook>'


def _workbooks(df: DataFrame, rows_per_book: int, date: str | None = None, first_row: int = 1) -> DataFrame:
    """Minimal workbooks (path, content) holding the table, `rows_per_book` keys each. The numbers of
    the column `date` are days; every second workbook counts them from 1904."""
    names = df.columns

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["_book"].iloc[0])
        late = date is not None and number % 2 == 1
        if late:
            frame[date] -= 1462  # days from 1899-12-30 to 1904-01-01
        styles = [' s="1"' if c == date else "" for c in names]
        lines = [names, *frame[names].itertuples(index=False)]
        cells = [
            "".join(
                f"<c{style}><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                for v, style in zip(line, styles)
            )
            for line in lines
        ]
        sheet = _SHEET.format("".join(f'<row r="{i}">{c}</row>' for i, c in enumerate(cells, first_row)))
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as book:
            book.writestr("xl/worksheets/sheet1.xml", sheet)
            book.writestr("xl/styles.xml", _STYLES)
            if late:
                book.writestr("xl/workbook.xml", _BOOK_1904)
        return pd.DataFrame({"path": [f"book-{number}"], "content": [content.getvalue()]})

    books = df.withColumn("_book", F.floor(F.col(names[0]) / rows_per_book))
    return books.groupBy("_book").applyInPandas(build, "path string, content binary")


@plan("scan_xlsx", CUSTOMER_SQL)
def scan_xlsx(spark, sf_dir):
    """Workbooks are built from the table by Spark, 500 keys each, then decoded again."""
    return read_workbooks(_workbooks(table(spark, sf_dir, "customer"), 500))


@plan("dataset_roundtrip", "select * from orders")
def dataset_roundtrip(spark, sf_dir):
    register_dataset(table(spark, sf_dir, "orders"), "orders_dataset", scratch_dir(spark, "dataset"))
    return open_dataset(spark, "orders_dataset")


@plan("dataset_meta", "select 'orders.parquet' as filename, count(*) as rows from orders union all select 'part.parquet', count(*) from part")
def dataset_meta_plan(spark, sf_dir):
    """Which files the rows of two tables come from."""
    parts = [rows_per_file(table(spark, sf_dir, name)) for name in ("orders", "part")]
    return parts[0].unionByName(parts[1]).select("filename", "rows")


@plan("scan_csv_many_headers", CUSTOMER_SQL)
def scan_csv_many_headers(spark, sf_dir):
    """Files of one table whose headers have the columns in different orders."""
    customer, paths = table(spark, sf_dir, "customer"), []
    for i, columns in enumerate((customer.columns, customer.columns[::-1])):
        paths.append(scratch_dir(spark, "scan_csv_headers"))
        write_csv(customer.where(F.col("c_custkey") % 2 == i).select(*columns), paths[-1])
    return read_csv(spark, paths)


def _dated_books(orders: DataFrame) -> DataFrame:
    """Orders written as workbooks of 5,000 keys and read again."""
    orders = orders.select("o_orderkey", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice")
    days = (micros(F.col("o_orderdate")) / 86_400_000_000 + 25569).alias("o_orderdate")  # days from the year-1900 zero
    return read_workbooks(_workbooks(orders.select("o_orderkey", days, "o_totalprice"), 5000, date="o_orderdate", first_row=3))


_DATED_SQL = "select o_orderkey, date_trunc('second', o_orderdate) as o_orderdate, o_totalprice from orders"


@plan("scan_xlsx_dates_whole", _DATED_SQL)
@plan("scan_xlsx_dates", _DATED_SQL)
def scan_xlsx_dates(spark, sf_dir):
    """Date cells come back as timestamps, in either date system; the header is not the first row."""
    return _dated_books(table(spark, sf_dir, "orders"))


@plan("sink_parquet", WITH_DIRTY + "select c_custkey, trim(name, concat(' ', chr(9))) as name, age, email, code from dirty")
def sink_parquet(spark, sf_dir):
    path = scratch_dir(spark, "sink_parquet")
    write_parquet(clean(dirty(spark, sf_dir)), path)
    return spark.read.parquet(path)


@plan(
    "sink_csv",
    WITH_DIRTY + "select c_custkey, trim(name, concat(' ', chr(9))) as name, cast(age as bigint) as age, email, code from dirty",
)
def sink_csv(spark, sf_dir):
    path = scratch_dir(spark, "sink_csv")
    write_csv(clean(dirty(spark, sf_dir)), path)
    return read_csv(spark, path)


@plan("sink_table_append", "select s_nationkey, count(*) * 2 as loaded from supplier group by 1")
def sink_table_append(spark, sf_dir):
    """Append twice to a new table, then count what it holds."""
    path = scratch_dir(spark, "sink_table")
    name = "loaded_" + path.split("/")[-2].split("-")[-1]
    for _ in range(2):
        load_table(table(spark, sf_dir, "supplier"), name, path=path)
    loaded = spark.read.parquet(path)  # the table's files; the catalog entry itself is not kept
    spark.sql(f"drop table {name}")
    return loaded.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("loaded"))


@plan("scan_by_ending", "select 'csv' as ending, s_suppkey, s_name, s_acctbal from supplier union all select 'parquet', s_suppkey, s_name, s_acctbal from supplier union all select 'xlsx', s_suppkey, s_name, s_acctbal from supplier")
def scan_by_ending(spark, sf_dir):
    """The format is told by a file's ending; the same rows come back from each."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    base = scratch_dir(spark, "scan_by_ending")
    write_csv(supplier, f"{base}/supplier.csv")
    write_parquet(supplier, f"{base}/supplier.parquet")
    books = _workbooks(supplier, 10_000)
    parts = [read_table(spark, f"{base}/supplier.{e}").withColumn("ending", F.lit(e)) for e in ("csv", "parquet")]
    parts.append(read_workbooks(books).withColumn("ending", F.lit("xlsx")))
    rows = [p.select("ending", "s_suppkey", "s_name", "s_acctbal") for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan(
    "scan_csv_rejected",
    "select 'as it is' as upload, 'read' as outcome, count(*) as rows from nation union all select 'with a longer row', 'rejected', null union all select 'without its first column', 'rejected', null",
)
def scan_csv_rejected(spark, sf_dir):
    """What becomes of a good upload, one with a row too long, and one of files that differ in their columns."""
    nation, found = table(spark, sf_dir, "nation"), []
    long_row = nation.withColumn("n_name", F.when(F.col("n_nationkey") == 7, F.lit('x"1,2"y')).otherwise(F.col("n_name")))
    for upload, parts in (("as it is", [nation]), ("with a longer row", [long_row]), ("without its first column", [nation, nation.drop("n_nationkey")])):
        path = scratch_dir(spark, "scan_csv_rejected")
        for i, part in enumerate(parts):
            names = part.columns
            lines = part.select(F.concat_ws(",", *names).alias("value")).coalesce(1)
            head = spark.createDataFrame([(",".join(names),)], "value string")
            head.unionByName(lines).coalesce(1).write.text(f"{path}/{i}")
        try:
            found.append((upload, "read", read_csv(spark, [f"{path}/{i}" for i in range(len(parts))]).count()))
        except Exception:  # of Spark or of the reader: the upload is refused as a whole
            found.append((upload, "rejected", None))
    return spark.createDataFrame(found, "upload string, outcome string, rows long")
