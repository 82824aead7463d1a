import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import coerce_timestamp, iso_text, micros, python_regex, strict_timestamp, strip, timestamp_text, to_number
from plumbline.functions.text import WHITESPACE


def _one(spark, values, expr, schema="string"):
    """Evaluate expr over a column `v`, results in input order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if not chr(i).strip()}


def test_strip_like_python(spark):
    values = ["a", "  a b ", *[f"{w}x{w}y{w}" for w in WHITESPACE], "​keep​", "", " \t\n"]
    assert _one(spark, values, strip) == [v.strip() for v in values]


def test_to_number(spark):
    cases = {
        " 12 ": 12.0, "1e3": 1000.0, "-.5": -0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf"),
        "nan": None, "1d": None, "1_000": None, "0x10": None, "True": None, "": None, "1 2": None, "1e": None, None: None,
    }
    assert _one(spark, list(cases), to_number) == list(cases.values())


PATTERNS = [
    r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"\w+", r"\d{2,3}$", r"[]a]+", r"[^]a]+", r"[[a]b", r"(?P<a_b>x+)-(?P=a_b)",
    r"(?i)É", r"a|b", r"\s", r".*\Z", r"[a&&b]+$", r"\bno\b",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_regex_like_python(spark, pattern):
    values = ["a@b.c", "a@b", " é", "É", "é9", "12", "1234", "x-x", "xx-xx", "xx-x", "]", "[b", "&a", "a\n", "12\n",
              "a\r", "b ", " ", "٣٤", "no", "know", "", "a]b", "&&"]
    want = [bool(re.match(pattern, v)) for v in values]
    assert _one(spark, values, lambda c: c.rlike(python_regex(pattern))) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\x1c a　b​", max_size=8), min_size=1, max_size=30))
def test_strip_property(spark, values):
    assert _one(spark, values, strip) == [v.strip() for v in values]


def test_coerce_timestamp(spark):
    cases = {
        "2024-01-02": "2024-01-02 00:00:00",
        "2024-01-02T03:04:05": "2024-01-02 03:04:05",
        " 2024-01-02 03:04:05.5 ": "2024-01-02 03:04:05.500000",
        "1/2/2024": "2024-01-02 00:00:00",
        "2024/3/4": "2024-03-04 00:00:00",
        "20240305": "2024-03-05 00:00:00",
        "5 Mar 2024": "2024-03-05 00:00:00",
        "05-Mar-2024": "2024-03-05 00:00:00",
        "Mar 5, 2024": "2024-03-05 00:00:00",
        "March 15, 2024": "2024-03-15 00:00:00",
        "12-31-2023": "2023-12-31 00:00:00",
        "12/31/2023 7:05": "2023-12-31 07:05:00",
        "1/2/2024 13:05:09": "2024-01-02 13:05:09",
        "2024/3/4 1:02:03": "2024-03-04 01:02:03",
        "20241399": None,
        "2024": None,
        "12:30": None,
        "13/13/2024": None,
        "soon": None,
        "": None,
        None: None,
    }
    assert _one(spark, list(cases), lambda c: timestamp_text(coerce_timestamp(c))) == list(cases.values())


def test_strict_timestamp_fails_on_bad_value(spark):
    assert _one(spark, ["2024-01-01", None], lambda c: iso_text(strict_timestamp(c))) == ["2024-01-01T00:00:00", None]
    with pytest.raises(Exception, match="not a timestamp"):
        _one(spark, ["2024-01-01", "x"], strict_timestamp)


def test_micros_keep_order_in_any_time_zone(spark):
    values = ["1969-12-31 23:59:59.999999", "2024-03-10 01:59:59", "2024-03-10 02:30:00", "2024-03-10 03:00:00.000001"]
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = _one(spark, values, lambda c: micros(c.cast("timestamp_ntz")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert got[0] == -1 and got[2] - got[1] == 1801 * 10**6 and got[3] - got[2] == 1800 * 10**6 + 1
