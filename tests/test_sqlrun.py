import pytest

from plumbline.operators import QueryError, preview_sql, run_sql


def test_queries(spark, people):
    assert run_sql(people, "SELECT * FROM loaded_table LIMIT 2").count() == 2
    assert run_sql(people, "SELECT COUNT(*) as cnt FROM loaded_table;").first()["cnt"] == 3
    assert [r[0] for r in run_sql(people, 'SELECT "name" FROM loaded_table ORDER BY "age" DESC').collect()] == ["Alice", "Bob", "Charlie"]
    joined = run_sql(people, "WITH o AS (SELECT age FROM older) SELECT count(*) AS n FROM loaded_table JOIN o USING (age)", {"older": people.where("age > 25")})
    assert joined.first()["n"] == 1


@pytest.mark.parametrize(
    "sql",
    ["", " ; ", "INVALID SQL GARBAGE", "SELECT nope FROM loaded_table", "DROP TABLE x", "CREATE TABLE t AS SELECT 1",
     "INSERT INTO loaded_table VALUES (1)", "SET spark.sql.ansi.enabled=false", "SELECT 1; DROP VIEW loaded_table",
     "SELECT 1) t; SELECT (1", "EXPLAIN SELECT 1", "DELETE FROM loaded_table", "CACHE TABLE loaded_table"],
)
def test_anything_else_is_refused(people, sql):
    with pytest.raises(QueryError):
        run_sql(people, sql)


def test_session_is_left_as_it_was(spark, people):
    run_sql(people, "SELECT 1 AS one").collect()
    assert not spark.catalog.tableExists("loaded_table")
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"
    assert not [t for t in spark.catalog.listTables("global_temp") if t.namespace == ["global_temp"]]


def test_preview(spark, people):
    assert preview_sql("users", ["name", "age"]) == "SELECT `name`, `age` FROM `users` LIMIT 100"
    assert preview_sql("users", ["od`d"]) == "SELECT `od``d` FROM `users` LIMIT 100"
    assert run_sql(people, preview_sql("loaded_table", people.columns)).count() == 3
