import os

import pytest

import __spark_entry__
from shelfspark.plans import further, general, queries
from tests.compare import connect, rows, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
OWN = {**general.QUERIES, **queries.QUERIES, **further.QUERIES}
SQL = {**general.ORACLE, **queries.ORACLE, **further.ORACLE}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert rows(OWN[name](spark, SF)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", ["layout_lines", "clean_text"])
def test_query_runs(spark, name):
    assert OWN[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(SQL) <= set(OWN) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["table_name", "row_id", "kind"]


def test_layout_lines_has_short_pages_too(spark):
    text = spark.read.parquet(f"{SF}/documents.parquet").filter(r"text rlike '\\p{L}'").select("doc_id")
    got = OWN["layout_lines"](spark, SF).select("file_id").distinct()
    assert text.join(got, text.doc_id == got.file_id, "left_anti").count() == 0


@pytest.mark.parametrize("name", ["rerank_scores", "unanswerable_relevance", "excerpts", "hybrid_search", "question_answers", "fused_ranks"])
def test_texts_are_joined_and_written_once(spark, name):
    assert not any("chunks.parquet" in f for f in OWN[name](spark, SF).inputFiles())


def test_hits_read_texts_written_once(spark):
    assert not any("chunks.parquet" in f for f in queries._hits(spark, SF)[0].inputFiles())


def test_retrieval_metrics_search_for_the_whole_text(spark, monkeypatch):
    from shelfspark.operators import search

    seen = []
    found = search.bm25
    monkeypatch.setattr(search, "bm25", lambda docs, q, *a: seen.append(q) or found(docs, q, *a))
    OWN["retrieval_metrics"](spark, SF)
    assert seen[0].selectExpr("max(size(terms)) as n").first().n > 32
