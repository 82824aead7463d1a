"""Column names as they come from files: any text, dots and spaces included."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def all_named(names: Iterable[str]) -> list[Column]:
    return [named(n) for n in names]
