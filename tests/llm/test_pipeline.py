"""The pipeline and all registered queries on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from spanloom.llm import decontaminate, jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark", "secrets", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before
    assert jaccard.jaccard_groups(docs).where("component_id <> doc_id").isEmpty()
    assert decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(items) >= 2").isEmpty()
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().collect()} == ids


def test_stages_on_an_empty_table_and_nulls(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], docs.schema)
    for i, table in enumerate((docs.limit(0), odd)):
        own = table
        for name, stage in corpus_pipeline.STAGES:
            own = stage(spark, own, SF)
            own.write.parquet(str(tmp_path / f"{i}{name}"))
            own = spark.read.parquet(str(tmp_path / f"{i}{name}"))
        assert own.count() == table.count()


def test_near_duplicates_are_judged_by_row(spark, make):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = make([(1, a), (5, a + " more"), (5, b), (5, c), (5, c), (5, None), (7, b), (None, a)])
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(1, a), (5, b), (5, c), (5, ""), (-1, a)])


def test_sql(spark):
    from spanloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, expected = queries.queries()[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(expected.columns)
        rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(expected), name
