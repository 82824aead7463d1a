import pytest
from pyspark.sql import types as T

from plumbline.sources import load_rules
from plumbline.streaming import clean_stream, follow_uploads, write_uploads


def test_each_upload_is_cleaned_once(spark, tmp_path):
    uploads, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    uploads.mkdir()
    schema = T.StructType().add("name", "string").add("age", "integer").add("email", "string")
    rows = clean_stream(follow_uploads(spark, str(uploads), schema), load_rules("rules/basic.yaml"))
    (uploads / "a.csv").write_text("name,age,email\n  Alice ,30,a@example.com\nBob,-5,invalid\n")
    write_uploads(rows, out, mark).awaitTermination()
    (uploads / "b.csv").write_text("name,age,email\nEve,NA,\n")
    write_uploads(rows, out, mark).awaitTermination()
    got = {r["name"]: (r["age"], r["failed"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        "Alice": (30, []),
        "Bob": (-5, ["age: Values below min 0", "email: Regex mismatch"]),
        "Eve": (None, []),
    }


def test_columns_of_an_upload_go_by_its_own_header(spark, tmp_path):
    uploads, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    uploads.mkdir()
    schema = T.StructType().add("name", "string").add("email", "string").add("n", "double")
    (uploads / "a.csv").write_text('email,n,name\ne@x.com,1d,"Eve, ""the\nfirst"""\n,2\n')
    write_uploads(follow_uploads(spark, str(uploads), schema), out, mark).awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert got == [('Eve, "the\nfirst"', "e@x.com", None), (None, None, 2.0)]


@pytest.mark.parametrize("text", ["name,email\nx,y,z\n", "name,other\nx,y\n", "name\nx\n"])
def test_an_upload_that_does_not_fit_fails_the_stream(spark, tmp_path, text):
    uploads = tmp_path / "in"
    uploads.mkdir()
    (uploads / "a.csv").write_text(text)
    schema = T.StructType().add("name", "string").add("email", "string")
    with pytest.raises(Exception, match="other columns|more fields"):
        write_uploads(follow_uploads(spark, str(uploads), schema), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
