"""What the operators of this subpackage share: stored tables, safe names, the learning split."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder of the cluster and read again.

    It cuts the lineage: row numbers and other values that a repeated task could make
    differently are fixed, and a lost executor costs nothing that was stored before.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes `stored` tables that nothing will read any more, as later stored ones stand for them. Without it
    they would stay on the shared disk until the session ends."""
    jvm = tables[0].sparkSession.sparkContext._jvm
    settings = tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for file in table.inputFiles()[:1]:  # all are in one folder
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(settings).delete(folder, True)


def renewed(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that both sides of a cogroup may come from one table."""
    return df.select(*[quoted(c).alias(c) for c in df.columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, label: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{label}"
    while name in taken:
        name = "_" + name
    return name


def whole(text: str) -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(quoted(text), F.lit(""))


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as empty text."""
    return F.crc32(F.coalesce(quoted(key).cast("string"), F.lit(""))) % parts


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: bytes) -> bytes:
    """A-Z in lower case in UTF-8: bytes.lower() knows ASCII only, so no other character changes."""
    return text.lower()


def utf8(column) -> Iterator[bytes]:
    """The values of an Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""
