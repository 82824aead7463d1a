"""CSV with a header and inferred types.

Files with line breaks inside quotes are split among tasks like all others. Whether a byte range begins inside
quotes depends on all bytes before it, so the ranges are read twice: first each range tells how it would
end if it began outside and if it began inside; these answers, put together along each file, give the true
beginnings; then each range makes its records, and pieces of records that cross ranges are joined.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import named
from ..session import ensure_checkpoint_dir
from .typing import cast_text, infer_types, tokens_to_null, typed_as, unique_names

_RAW = "_raw"
QUOTED = r'"(?:[^"]|"")*"'
# a field behind a comma: quotes count at its start only; possessive, as long texts would exhaust the stack
FIELD = r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+|$)|[^,]*+)'


def split_header(line: str) -> tuple[str, ...]:
    """Column names of a header line."""
    cells = next(csv.reader([line.removeprefix("﻿")]), [])
    return tuple(unique_names(cells))


def field_count(record: Column) -> Column:
    """How many fields a record has. Commas in a field that begins with a quote do not count up to its end quote; quotes
    elsewhere are letters."""
    return F.size(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1)))


def _file_kinds(spark: SparkSession, path: str | list[str]) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """(header, may have line breaks inside quotes) -> files, from one scan of the lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    stray = F.col("value").rlike(r'(?:^|,)[^",]++"')  # a quote that is a letter: numbers of quotes say nothing
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"), ((quotes % 2 == 1) | stray).alias("open"))
    per_file = lines.where("value <> ''").groupBy("file").agg(F.min_by("value", "place").alias("header"), F.bool_or("open").alias("open"))
    kinds: dict[tuple, list[str]] = {}
    for r in per_file.groupBy("header", "open").agg(F.collect_list("file").alias("files")).toLocalIterator():
        kinds.setdefault((r["header"], r["open"]), []).extend(r["files"])
    return {(split_header(header), open_): sorted(files) for (header, open_), files in kinds.items()}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the line ends inside quotes, if it begins `inside` or at the start of a field."""
    at = 0
    if not inside and line.startswith('"'):
        at, inside = 1, True
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):  # a doubled quote is a letter
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside = False
        at = line.find(",", at) + 1
        if not at:
            return False
        if line.startswith('"', at):
            at, inside = at + 1, True


def _ranges(batches) -> Iterator[tuple[int, int, str]]:
    """Rows (file, block, value), in the order of the files' lines -> (file, block, line) one by one."""
    for batch in batches:
        yield from zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist())


def _range_ends(batches) -> Iterator:
    """(file, block) -> whether its last line ends inside quotes, for both ways to begin."""
    import pyarrow as pa

    ends: dict[tuple, list[bool]] = {}
    for file, block, line in _ranges(batches):
        state = ends.setdefault((file, block), [False, True])
        if '"' in line:
            state[:] = [ends_inside(line, s) for s in state]
    if ends:
        columns = [[f for f, _ in ends], [b for _, b in ends], *zip(*ends.values())]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "if_out", "if_in"])


WHOLE, LAST_OF, MIDDLE, FIRST_OF = range(4)  # a record, or the end, a middle and the beginning of one that crosses ranges


def _records(batches) -> Iterator:
    """Lines with `inside`, how their range begins -> records and pieces of records, blank ones and each file's first left out."""
    import pyarrow as pa

    names = ["file", "block", "kind", "record"]
    made: list[tuple] = []
    place, held, kind, header, inside = None, [], WHOLE, False, False

    def finish(last: int):
        nonlocal header
        text = "\n".join(held)
        if last == WHOLE:
            text = text.removesuffix("\r")
            if header or not text.strip():
                header = header and not text.strip()
                return
        made.append((*place, last, text))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.int64(), pa.int64(), pa.int32(), pa.string()])], names=names)

    for b in batches:
        for file, block, line, began in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value", "inside"))):
            if (file, block) != place:
                if held:  # the range before ends inside a record
                    finish(MIDDLE if kind == LAST_OF else FIRST_OF)
                place, held, inside, header = (file, block), [], began, block == 0
                kind = LAST_OF if began else WHOLE
            held.append(line)
            if '"' in line:
                inside = ends_inside(line, inside)
            if not inside:
                finish(kind)
                held, kind = [], WHOLE
                if len(made) >= 10_000:
                    yield batch()
                    made = []
    if held:
        finish(MIDDLE if kind == LAST_OF else FIRST_OF)
    if made:
        yield batch()


def split_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """The records (column `record`) of CSV files without their headers, in tasks of byte ranges."""
    file = F.xxhash64("_metadata.file_path").alias("file")
    lines = spark.read.option("lineSep", "\n").text(files).select(file, F.col("_metadata.file_block_start").alias("block"), "value")
    ends = lines.mapInArrow(_range_ends, "file long, block long, if_out boolean, if_in boolean")
    # a range whose end does not depend on its beginning settles it; the others keep the state or turn it over
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("if_out") & ~F.col("if_in"), 1).otherwise(0)).over(W.partitionBy("file").orderBy("block"))
    known = ends.withColumn("turns", turns).withColumn("settled", F.when(F.col("if_out") == F.col("if_in"), F.struct("if_out", "turns")))
    known = known.withColumn("last", F.last("settled", ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.max("turns").over(before), F.lit(0)))
    turned = (F.col("so_far") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", F.coalesce(F.col("last.if_out"), F.lit(False)) != turned)
    ensure_checkpoint_dir(spark)
    # of every range some 100 MB long at most one row of 17 bytes
    begun = F.broadcast(known.where("inside").select("file", "block", "inside").checkpoint())
    placed = lines.join(begun, ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    pieces = placed.select("file", "block", "value", "inside").mapInArrow(_records, "file long, block long, kind int, record string")
    crossing = pieces.where(F.col("kind") != WHOLE)
    along = W.partitionBy("file").orderBy("block", "kind")
    number = F.sum(F.when(F.col("kind") == FIRST_OF, 1).otherwise(0)).over(along)
    joined = crossing.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"))
    crossed = joined.select(F.rtrim(F.array_join(F.transform("parts", lambda p: p["record"]), "\n"), F.lit("\r")).alias("record"))
    return pieces.where(F.col("kind") == WHOLE).select("record").unionByName(crossed)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV files that have the same columns, in any order of their own.

    Without a schema the files are scanned once more to find the types; with one, values that do
    not fit its types become NULL. Short rows are padded with NULL; a row longer than its header
    fails the scan, and files without columns or with different ones are an error. Files with line
    breaks inside quotes are split among tasks too, at the price of one more scan; `multi_line` says for all
    files which kind they are. Quotes count at the start of a field only.
    """
    empty = spark.read.format("binaryFile").load(path).where("length = 0").select("path").limit(1).collect()
    kinds = _file_kinds(spark, path)
    if empty or not kinds:
        raise ValueError(f"no columns to read in {empty[0]['path'] if empty else path}")
    header = min(kinds)[0]
    for names, _ in kinds:
        if set(names) != set(header):
            raise ValueError(f"files in {path} have different columns: {sorted(set(names) ^ set(header))}")
    if len(kinds) == 1:
        header = next(iter(kinds))[0]
    parts = [_read_kind(spark, files, names, open_ if multi_line is None else multi_line) for (names, open_), files in sorted(kinds.items())]
    text = reduce(DataFrame.unionByName, parts).select(*[tokens_to_null(named(name)).alias(name) for name in header])
    if schema is None:
        return cast_text(text, infer_types(text))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return text.select(*[typed_as(named(f.name), f.dataType).alias(f.name) for f in wanted])


def _read_kind(spark: SparkSession, files: list[str], header: tuple[str, ...], multi_line: bool) -> DataFrame:
    """Files of one header, all columns as text."""
    fields = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _RAW]])
    # a record that has not the header's number of fields is kept whole in _RAW; pruning would not see it
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": _RAW, "maxCharsPerColumn": "-1"}
    if multi_line:
        parsed = F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in fields), options)
        text = split_records(spark, files).select(parsed.alias("_r")).select(*[F.col("_r").getField(f.name).alias(f.name) for f in fields])
    else:
        text = spark.read.options(header=True, columnPruning=False, **options).schema(fields).csv(files)
    # a query must look at another column than _RAW, so the message does
    long_row = F.raise_error(F.concat(F.lit("a row has more fields than its header, it begins with "), F.coalesce(named(header[0]), F.lit("nothing")))).cast("boolean")
    fits = F.when(F.col(_RAW).isNull(), True).when(field_count(F.col(_RAW)) <= len(header), True).otherwise(long_row)
    return text.where(fits).drop(_RAW)
