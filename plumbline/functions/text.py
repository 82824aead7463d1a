"""Text and number expressions that give Python's answers on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import named

# The code points Python's str.strip() removes.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What counts as a number in text. Spark's own cast would also take Java forms such as '1d'.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lower_case(c: Column) -> Column:
    return F.lower(c)


def upper_case(c: Column) -> Column:
    return F.upper(c)


def nan_to_null(c: Column) -> Column:
    """NaN is a missing value; Spark would otherwise order it last and let it poison averages."""
    return F.nanvl(c, F.lit(None).cast("double"))


def is_number(text: Column) -> Column:
    return strip(text).rlike(NUMBER)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a number, and NaN, becomes NULL."""
    return nan_to_null(F.when(is_number(text), strip(text).try_cast("double")))


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def number_of(df: DataFrame, name: str) -> Column:
    """The column as a double, whatever its type; NULL where it holds no number."""
    c, dtype = named(name), df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return to_number(c.cast("string"))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL; other types unchanged."""
    c = named(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def python_text(c: Column) -> Column:
    """A double as Python writes it: plain digits from 1e-4 to 1e16, else the form 1e+16 or 1.5e-05."""
    text, size = c.cast("string"), F.abs(c)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(text.contains("E"), F.regexp_replace(digits, r"\.$", ".0")).otherwise(text)
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    short = F.concat(mantissa, F.when(text.contains("E-"), "e-").otherwise("e+"), power)
    special = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return special.when((c == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(short)


def _java_group(name: str) -> str:
    return name.replace("_", "U95")  # Java group names take no underscore


def python_regex(pattern: str) -> str:
    """A Python pattern, matched at the start of the text, for use with rlike."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_java_group(m[1])}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{_java_group(m[1])}>", pattern)
    out, class_start = [], None  # class_start: where the open [...] began in `out`
    for token in re.findall(r"\\.|.", pattern, flags=re.S):
        if class_start is None:
            if token == "[":
                class_start = len(out)
            out.append("\\z" if token == "\\Z" else token)
            continue
        first = out[class_start + 1 :] in ([], ["^"])
        if token == "]" and not first:
            class_start = None
        elif token in ("[", "&") or token == "]":
            token = "\\" + token  # literal in Python, special inside a Java class
        out.append(token)
    return "(?Ud)\\A(?:" + "".join(out) + ")"
