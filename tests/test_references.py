from datetime import datetime as D

from shelfspark.operators import references as ref
from shelfspark.util import hot_keys


def frame(spark, rows):
    return spark.createDataFrame(rows, "table_name string, row_id long, ref_key string, at timestamp")


def intervals(spark, parents, gone):
    p = spark.createDataFrame(parents, "table_name string, ref_key string, since timestamp")
    d = spark.createDataFrame(gone, "table_name string, ref_key string, gone_at timestamp")
    return ref.parent_intervals(p, d)


def kinds(df):
    return {r.row_id: r.kind for r in df.collect()}


def test_kinds_nulls_and_copies(spark):
    refs = frame(spark, [("t", 1, "a", D(2020, 1, 2)), ("t", 1, "a", D(2020, 1, 2)), ("t", 2, None, D(2020, 1, 1)), ("t", 3, "x", None), ("t", 4, "gone", D(2020, 1, 1)), ("t", 5, "again", D(2020, 1, 1)), ("t", 6, "late", D(2020, 1, 1)), ("t", 7, "late", None), ("t", 8, "free", D(2020, 1, 1)), ("u", 9, "a", None)])
    both = intervals(spark, [("t", "a", D(2020, 1, 2)), ("t", "again", D(2019, 1, 1)), ("t", "late", D(2021, 1, 1)), ("t", "late", D(2022, 1, 1)), ("t", "free", None), ("t", None, None)], [("t", "gone", None), ("t", "gone", D(2020, 1, 1)), ("t", "again", D(2018, 1, 1))])
    got = ref.broken_references(refs, both)
    assert kinds(got) == {3: "missing", 4: "deleted", 6: "late", 9: "missing"} and got.count() == 4
    month = {(r.table_name, r.month, r.kind, r.n) for r in ref.per_month(got).collect()}
    assert ("t", "2020-01", "deleted", 1) in month and ("t", None, "missing", 1) in month


def test_hot_key_is_salted_and_gives_the_same(spark):
    rows = [("t", i, "hot" if i % 3 else f"k{i}", D(2020, 1, 1)) for i in range(40_000)]
    refs = frame(spark, rows)
    assert [r.ref_key for r in hot_keys(refs.filter("ref_key is not null"), ["table_name", "ref_key"]).collect()] == ["hot"]
    got = ref.broken_references(refs, intervals(spark, [("t", "hot", D(2021, 1, 1))], []))
    assert {(r.kind, r["count"]) for r in got.groupBy("kind").count().collect()} == {("late", sum(1 for i in range(40_000) if i % 3)), ("missing", sum(1 for i in range(40_000) if not i % 3))}
    assert "SortMergeJoin" in got._jdf.queryExecution().toString()


def test_empty_tables(spark):
    none = intervals(spark, [], [])
    assert kinds(ref.broken_references(frame(spark, [("t", 1, "a", None)]), none)) == {1: "missing"}
    assert ref.broken_references(frame(spark, []), none).count() == 0


def test_session_keys_without_blanks_and_case(spark):
    chunks = spark.createDataFrame([], "chunk_id long, file_id long, written_at timestamp")
    messages = spark.createDataFrame([(1, "  ABC​", None), (2, "abd", None), (3, "  ", None)], "id long, session_id string, created_at timestamp")
    files = spark.createDataFrame([], "file_id long, indexed_at timestamp")
    sessions = spark.createDataFrame([("abc", None)], "session_id string, created_at timestamp")
    gone = spark.createDataFrame([("sessions", "ABD ", None), ("files", "x", None)], "table_name string, row_key string, deleted_at timestamp")
    got = ref.broken_references(ref.library_references(chunks, messages), ref.library_intervals(files, sessions, gone))
    assert kinds(got) == {2: "deleted", 3: "missing"}
