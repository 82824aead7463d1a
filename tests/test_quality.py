import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import (
    merge_states,
    profile_of,
    profile_state,
    check_counts,
    clean,
    clean_observed,
    column_profile,
    column_types,
    compile_rules,
    drop_duplicate_rows,
    first_rows,
    infer_date_col,
    infer_value_col,
    list_rules_report,
    numeric_columns,
    profile_dataset,
    repeated_rows,
    summarize,
    validate_dataframe,
    validation_report,
    violating_rows,
)
from plumbline.sources import load_rules

BASIC = load_rules("rules/basic.yaml")


def _profile(df):
    return {r["name"]: r for r in column_profile(df).collect()}


def test_profile_people(people):
    p = _profile(people)
    assert list(p) == ["name", "age", "email"]
    assert (p["age"]["min"], p["age"]["max"], round(p["age"]["mean"], 6)) == (-5.0, 30.0, round(50 / 3, 6))
    assert p["name"]["mean"] is None and p["name"]["null_count"] == 0
    assert first_rows(people, "age").first()["name"] == "Charlie"
    assert column_types(people) == {"name": "string", "age": "bigint", "email": "string"}


def test_profile_as_a_dictionary(spark, people):
    got = profile_dataset(people, "age")
    assert got["row_count"] == 3 and got["sample_rows"][0] == {"name": "Charlie", "age": -5, "email": "invalid"}
    assert [c["name"] for c in got["columns"]] == ["name", "age", "email"]
    assert got["columns"][0]["stats"] is None and got["columns"][1]["stats"]["max"] == 30.0
    assert len(profile_dataset(people)["sample_rows"]) == 3


def test_nested_columns_and_odd_names(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], "x "), (2, None, None)], "`a.b` int, `v c` array<float>, `t``k` string")
    assert [r["null_count"] for r in column_profile(df).orderBy("position").collect()] == [0, 1, 1]
    assert summarize(df).count() == 3
    rules = {"columns": {"a.b": {"type": "int", "max": 1, "unique": True}, "t`k": {"required": True, "regex": "y"}}}
    assert [e["row_sample"] for e in validate_dataframe(df, rules, "a.b")["errors"]] == [{2: 2}, {1: "x "}]
    assert clean(df, drop_duplicates=True).count() == 2
    assert violating_rows(df, rules, "a.b").count() == 2


def test_regex_on_booleans(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, b boolean")
    errors = validate_dataframe(df, {"columns": {"b": {"regex": "True"}}}, "id")["errors"]
    assert [e["row_sample"] for e in errors] == [{2: False}]


def test_profile_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, True, None, None), (nan, False, None, "x"), (None, True, None, None), (3.0, None, None, None)],
        "v double, b boolean, e double, s string",
    )
    p = _profile(df)
    assert numeric_columns(df) == ["v", "b", "e"]
    assert (p["v"]["null_count"], p["v"]["null_pct"], p["v"]["max"], p["v"]["mean"]) == (2, 0.5, 3.0, 2.0)
    assert round(p["v"]["std"], 6) == round(2**0.5, 6)
    assert p["b"]["mean"] == pytest.approx(2 / 3) and p["b"]["max"] == 1.0
    assert p["e"]["null_count"] == 4 and p["e"]["min"] is None and p["s"]["null_count"] == 3


def test_profile_edge_sizes(spark):
    empty = spark.createDataFrame([], "a int, s string")
    assert [(r["null_count"], r["null_pct"], r["mean"]) for r in column_profile(empty).collect()] == [(0, 0.0, None)] * 2
    one = spark.createDataFrame([(5,)], "a int")
    assert _profile(one)["a"]["std"] is None
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(95)])
    p = column_profile(wide).orderBy("position").collect()
    assert [r["min"] for r in p] == [float(i) for i in range(95)]
    assert summarize(wide).count() == 95


def test_validate_people(people):
    report = validate_dataframe(people, BASIC, "age")
    assert report["summary"] == {"error_count": 2}
    assert [(e["column"], e["message"], e["row_sample"]) for e in report["errors"]] == [
        ("age", "Values below min 0", {-5: -5}),
        ("email", "Regex mismatch", {-5: "invalid"}),
    ]
    assert validate_dataframe(people.where("age > 0"), BASIC)["errors"] == []
    missing = validate_dataframe(people.drop("name").where("age > 0"), BASIC)["errors"]
    assert [(e["column"], "required" in e["message"]) for e in missing] == [("name", True)]


def test_missing_value_beside_violation(spark):
    rows = [("Alice", 30, "a@example.com"), ("Bob", -5, "invalid"), (None, 25, "c@example.com")]
    df = spark.createDataFrame(rows, "name string, age int, email string")
    assert validate_dataframe(df, BASIC)["summary"]["error_count"] == 2


RULES = {
    "columns": {
        "n": {"type": "int", "min": 0, "max": 10},
        "t": {"type": "float", "min": 1},
        "u": {"unique": True, "regex": "[a-z]"},
        "gone": {"unique": True},
        "need": {"required": True},
        "f": {"type": "float", "max": 5.5},
        "s": {"type": "str", "min": 3},
    }
}


@pytest.fixture
def defects(spark):
    nan = float("nan")
    rows = [
        (0, 5, "1e1", "a", nan, "x"), (1, -1, "1d", "b", 6.0, None), (2, 11, " 0.5 ", "a", nan, None),
        (3, None, None, None, None, None), (4, 99, "x", None, 1.0, None), (5, 7, "nan", "9", 7.0, None),
    ]
    return spark.createDataFrame(rows, "id int, n int, t string, u string, f double, s string")


def test_every_rule_kind(defects):
    report = validation_report(defects, RULES, "id").collect()
    found = {(r["column"], r["message"]): r for r in report}
    assert {k: v["bad_rows"] for k, v in found.items()} == {
        ("n", "Values below min 0"): 1,
        ("n", "Values above max 10"): 2,
        ("t", "Type coercion to float failed"): 2,
        ("t", "Values below min 1"): 1,
        ("u", "Regex mismatch"): 1,
        ("u", "Duplicate values found"): 2,
        ("need", "Missing required column or all values null"): 1,
        ("f", "Values above max 5.5"): 2,
    }
    ids = lambda c, m: [s["row_id"] for s in found[(c, m)]["row_sample"]]
    assert ids("n", "Values above max 10") == [2, 4]
    assert ids("u", "Duplicate values found") == [0, 2]
    assert ids("t", "Type coercion to float failed") == [0, 1, 2]  # first rows of the column
    assert found[("need", "Missing required column or all values null")]["row_sample"] is None


def test_required_on_zero_rows_and_all_null(spark):
    empty = spark.createDataFrame([], "name string, age int, email string")
    assert [e["column"] for e in validate_dataframe(empty, BASIC)["errors"]] == ["name"]


def test_no_rules(people):
    assert validate_dataframe(people, {"columns": {}}) == {"errors": [], "summary": {"error_count": 0}}
    assert violating_rows(people, {}, "age").count() == 0


def test_rows_add_up_to_counts(defects):
    rules = {"columns": {k: v for k, v in RULES["columns"].items() if k != "need"}}
    per_rule = violating_rows(defects, rules, "id").groupBy("column", "message").count().collect()
    counts = check_counts(defects, compile_rules(defects, rules)).where("bad_rows > 0").collect()
    assert {(r["column"], r["message"], r["count"]) for r in per_rule} == {
        (r["column"], r["message"], r["bad_rows"]) for r in counts
    }


def test_duplicates_with_one_value_on_a_third_of_the_rows(spark):
    random.seed(1)
    values = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{random.randrange(400)}") for i in range(1500)]
    df = spark.createDataFrame(values, "id int, v string").repartition(6)
    seen, count = set(), {}
    for _, v in values:
        count[v] = count.get(v, 0) + 1
    got = {r["row_id"] for r in violating_rows(df, {"columns": {"v": {"unique": True}}}, "id").collect()}
    assert got == {i for i, v in values if v is not None and count[v] > 1}
    later = []
    for i, v in values:  # NULL equals NULL here
        if v in seen:
            later.append(i)
        seen.add(v)
    assert sorted(r["id"] for r in repeated_rows(df, "v", "id").collect()) == later
    report = validation_report(df, {"columns": {"v": {"unique": True}}}, "id").first()
    assert [s["row_id"] for s in report["row_sample"]] == sorted(got)[:3]


def test_list_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, v string")
    got = list_rules_report(df, {"required": ["id", "zip"], "unique": ["v", "id", "nope"]}, "id")
    assert got == {
        "ok": False,
        "issues": [
            {"type": "missing_column", "column": "zip"},
            {"type": "duplicate_values", "column": "v", "examples": ["a", None]},
        ],
    }
    assert list_rules_report(df, {"required": ["id"], "unique": ["id"]}, "id") == {"ok": True, "issues": []}


def test_clean(spark):
    df = spark.createDataFrame([("  Alice  ", 30), ("　Alice\t", 30), (" bob", None), (None, None), (None, None)], "name string, age int")
    assert sorted(r["name"] or "" for r in clean(df).collect()) == ["", "", "Alice", "Alice", "bob"]
    done = clean(df, normalize_case="upper", drop_duplicates=True)
    assert sorted(((r["name"] or ""), r["age"] or 0) for r in done.collect()) == [("", 0), ("ALICE", 30), ("BOB", 0)]
    again = clean(done, normalize_case="upper", drop_duplicates=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect()))
    assert clean(df, trim=False, normalize_case="title").collect() == df.collect()
    special = spark.createDataFrame([("straße ΣΑΣ",)], "s string")
    assert clean(special, normalize_case="upper").first()["s"] == "straße ΣΑΣ".upper()
    assert clean(special, normalize_case="lower").first()["s"] == "straße ΣΑΣ".lower()


def test_drop_duplicates_treats_nan_as_equal(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (1, nan), (1, None), (1, None)], "a int, b double")
    assert drop_duplicate_rows(df).count() == 2


def test_clean_counts_observed(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a ",), ("b",)], "s string")
    cleaned, before, after = clean_observed(df, drop_duplicates=True)
    cleaned.write.parquet(str(tmp_path / "out"))
    assert (before.get["rows"], after.get["rows"]) == (3, 2)


def test_column_inference(spark):
    typed = spark.createDataFrame([(1, "x", None)], "a int, day string, t timestamp_ntz")
    assert infer_date_col(typed) == "t"
    named = spark.createDataFrame([("2024-01-01", "2024-01-02", 5)], "other string, Date string, v int")
    assert infer_date_col(named) == "Date" and infer_value_col(named) == "v"
    rows = [("2024-01-01", "x", 1.0, 2), ("2024-01-02", "2024-01-01", 1.0, 2), ("2024-01-03", "y", 1.0, 2), ("?", "z", 1.0, 2)]
    shares = spark.createDataFrame(rows, "seen string, date string, p double, q int")
    assert infer_date_col(shares) == "seen"  # `date` has values that do not parse
    assert infer_value_col(shares) == "q"
    nothing = spark.createDataFrame([("2023", "a")], "yr string, s string")
    assert infer_date_col(nothing) is None and infer_value_col(nothing) is None


def test_states_of_parts_merge_to_the_state_of_the_whole(spark):
    import math

    rows = [(i, None if i % 7 == 0 else 1e9 + i % 100, f"t{i % 13}" if i % 5 else None, -i if i < 900 else None, float("nan") if i == 3 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, far double, text string, back long, `a.b` double").repartition(4)
    parts = [df.where(f"id % 4 = {k}") for k in range(4)] + [df.limit(0)]
    states = profile_state(parts[0])
    for part in parts[1:]:
        states = states.unionByName(profile_state(part))
    got = {r["name"]: r.asDict() for r in profile_of(merge_states(states)).collect()}
    want = {r["name"]: r.asDict() for r in profile_of(profile_state(df)).collect()}
    assert list(want) == df.columns and got.keys() == want.keys()
    for name, row in want.items():
        for figure, value in row.items():
            if not isinstance(value, float):
                assert figure.startswith("q") or got[name][figure] == value, (name, figure)
            elif figure in ("mean", "std"):  # a mean of 1e9 does not blur a deviation of 30
                assert math.isclose(got[name][figure], value, rel_tol=1e-9)
    far = [r[1] for r in rows if r[1] is not None]
    assert math.isclose(got["far"]["std"], (sum((v - sum(far) / len(far)) ** 2 for v in far) / (len(far) - 1)) ** 0.5, rel_tol=1e-7)
    assert (got["back"]["min"], got["back"]["max"], got["text"]["approx_distinct"]) == ("-899", "0", 13)
    again = profile_of(merge_states(merge_states(states.limit(10)).unionByName(states.limit(0)))).count()
    assert again == 5 and profile_of(merge_states(profile_state(df.limit(0)))).where("rows = 0 and mean is null and approx_distinct = 0").count() == 5


def test_day_first_is_decided_by_the_column(spark):
    from plumbline.operators import coerce_timestamps

    rows = [("13/01/2024", "01/13/2024", "3/4/2024", " 05-06-2024 7:08", "2024-02-03"), ("02/03/2024", "02/03/2024", "5/6/2024", "25-12-2023 23:59", "31/12/2020"), (None, "", "x", "12-25-2023 1:00", "99/99/2024")]
    got = [tuple(str(v) for v in r) for r in coerce_timestamps(spark.createDataFrame(rows, "a string, b string, c string, d string, `e.f` string"), ["a", "b", "c", "d", "e.f"]).collect()]
    assert got[0] == ("2024-01-13 00:00:00", "2024-01-13 00:00:00", "2024-03-04 00:00:00", "2024-05-06 07:08:00", "2024-02-03 00:00:00")
    assert got[1] == ("2024-03-02 00:00:00", "2024-02-03 00:00:00", "2024-05-06 00:00:00", "None", "2020-12-31 00:00:00")
    assert got[2] == ("None", "None", "None", "2023-12-25 01:00:00", "None")
