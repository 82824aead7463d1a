"""Every registered query runs over its tables; where SQL says it, the rows are DuckDB's."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm.queries import QUERIES, SQL


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document_at_least(spark, sf, documents, name):
    assert QUERIES[name](spark, sf).count() >= documents.count()


def test_native_queries_run_no_python(spark, sf):
    for name in ("op2_license_scan", "op7_fingerprints"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark, sf, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.schema.names == docs.schema.names
            out = spark.createDataFrame(out.collect(), out.schema)
            assert out.exceptAll(docs).isEmpty()
            docs = out
        sizes.append(out.select("doc_id").distinct().count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0.5 * documents.count()


def test_pipeline_run_over_odd_and_empty_tables(spark, odd, empty, documents, tmp_path_factory):
    for i, table in enumerate((odd.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars"), documents.limit(0))):
        folder = str(tmp_path_factory.mktemp(f"sf{i}"))
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert "sequence_id" in got.columns and (i == 0 or got.count() == 0)
