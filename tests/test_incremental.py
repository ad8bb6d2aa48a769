import pytest

from shelfspark.operators import incremental as inc


def seen(spark, *rows):
    return spark.createDataFrame(rows, "path_key string, size long, mtime double")


def test_only_changes_are_processed_and_failures_repeat(spark, tmp_path):
    target = inc.VersionedTarget(spark, str(tmp_path))
    worked = []

    def work(df):
        worked.append(sorted(r.path_key for r in df.collect()))
        return df

    def fail(df):
        raise RuntimeError("lost")

    first = seen(spark, ("a", 1, 1.0), ("b", 2, 2.0))
    inc.run_once(target, first, inc.FILES, process=work)
    second = seen(spark, ("a", 1, 1.0005), ("b", 3, 2.0), ("c", 1, 1.0))
    with pytest.raises(RuntimeError):
        inc.run_once(target, second, inc.FILES, process=fail)
    assert target.versions() == [1]  # nothing of the failed run can be seen
    inc.run_once(target, second, inc.FILES, process=work)
    inc.run_once(target, second, inc.FILES, process=work)
    assert worked == [["a", "b"], ["b", "c"], []]
    assert {r.path_key for r in target.read().collect()} == {"a", "b", "c"}
    inc.run_once(target, seen(spark, ("d", 1, 1.0)), inc.FILES, keep_unseen=True)
    assert {r.path_key for r in target.read().collect()} == {"a", "b", "c", "d"}


def test_two_runs_at_once_conflict(spark, tmp_path):
    target = inc.VersionedTarget(spark, str(tmp_path))
    target.publish(seen(spark, ("a", 1, 1.0)))
    with pytest.raises(inc.VersionConflict):
        target.publish(seen(spark, ("a", 2, 1.0)), expect=0)
    assert target.versions() == [1] and target.info(1)["label"] is None


def test_nulls_nan_clashing_columns_and_empty_tables(spark, tmp_path):
    state = spark.createDataFrame([("a", None, 1.0, 5), ("b", 1, float("nan"), 6), ("n", 1, 1.0, 1)], "path_key string, size long, mtime double, changed int")
    new = spark.createDataFrame([("a", None, 1.0, "x"), ("b", 1, float("nan"), "y"), (None, 1, 1.0, "z"), ("n", 1, 1.0, "q")], "path_key string, size long, mtime double, changed string")
    assert {r.path_key for r in inc.changed(new, state, inc.FILES).collect()} == {"b", None}
    assert inc.changed(new, state.limit(0), inc.FILES).count() == 4
    assert inc.changed(new.limit(0), state, inc.FILES).count() == 0
    assert inc.latest(new, ["path_key"], ["mtime"], ["size"]).count() == 3


def test_seen_takes_the_latest_entry_and_hot_keys_are_one_row(spark):
    rows = [(i, "hot", 1, 1.0, None) for i in range(3000)] + [(9000, "hot", 7, 1.0, None), (1, "gone", None, 1.0, None)]
    df = spark.createDataFrame(rows, "entry_id long, path_key string, size long, mtime double, seen_at timestamp")
    assert [tuple(r) for r in inc.seen_files(df).collect()] == [("hot", 7, 1.0)]


def test_replay_without_successful_runs(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 1.0, None)], "path_key string, size long, mtime double, indexed_at timestamp")
    runs = spark.createDataFrame([(1, "error")], "run_id long, state string")
    entries = spark.createDataFrame([], "entry_id long, run_id long, path_key string, size long, mtime double, seen_at timestamp")
    assert inc.replay_runs(files, runs, entries, str(tmp_path)).count() == 0


def test_small_differences_do_not_add_up(spark, tmp_path):
    target = inc.VersionedTarget(spark, str(tmp_path))
    for mtime in (1.0, 1.0007, 1.0014):
        inc.run_once(target, seen(spark, ("a", 1, mtime)), inc.FILES)
    assert [tuple(r) for r in target.read().select("mtime", "changed").collect()] == [(1.0014, False)]


def test_a_replay_that_dies_after_any_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a", 1, 1.0, None), ("b", 1, 1.0, None)], "path_key string, size long, mtime double, indexed_at timestamp")
    runs = spark.createDataFrame([(1, "done"), (2, "error"), (3, "done"), (4, "done")], "run_id long, state string")
    rows = [(1, 1, "a", 2, 1.0), (2, 1, "b", 1, 1.0), (3, 2, "b", 9, 1.0), (4, 3, "a", 2, 1.0), (5, 3, "c", 1, 1.0), (6, 4, "b", 1, 1.0)]
    entries = spark.createDataFrame([(*r, None) for r in rows], "entry_id long, run_id long, path_key string, size long, mtime double, seen_at timestamp")
    want = {(1, "a"), (3, "c"), (4, "b")}
    publish = inc.VersionedTarget.publish
    for alive in range(5):
        root, left = str(tmp_path / str(alive)), [alive]

        def dying(self, *args, **kwargs):
            if not left[0]:
                raise RuntimeError("lost")
            left[0] -= 1
            return publish(self, *args, **kwargs)

        monkeypatch.setattr(inc.VersionedTarget, "publish", dying)
        if alive < 4:
            with pytest.raises(RuntimeError):
                inc.replay_runs(files, runs, entries, root)
        left[0] = 99
        for _ in range(2):
            got = [tuple(r) for r in inc.replay_runs(files, runs, entries, root).collect()]
            assert sorted(got) == sorted(want)
        assert [label for _, label in inc.VersionedTarget(spark, root).labels()] == ["4", "3", "1", "start"]


def test_stream_of_entries(spark, tmp_path):
    from shelfspark.streaming.sync import follow

    schema = "entry_id long, path_key string, size long, mtime double, seen_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint, folder=source):
        follow(spark.readStream.schema(schema).parquet(folder), out, str(tmp_path / checkpoint)).awaitTermination(120)
        return {(r.path_key, r.size, r.changed) for r in inc.VersionedTarget(spark, out).read().collect()}

    spark.createDataFrame([(1, "a", 1, 1.0, None)], schema).write.parquet(source)
    assert run("cp") == {("a", 1, True)}
    spark.createDataFrame([(2, "b", 1, 1.0, None), (3, "a", 2, 1.0, None)], schema).write.mode("append").parquet(source)
    assert run("cp") == {("a", 2, True), ("b", 1, True)}
    assert run("cp") == {("a", 2, True), ("b", 1, True)}  # nothing new, nothing run
    # another stream with numbers of its own
    spark.createDataFrame([(4, "z", 1, 1.0, None)], schema).write.parquet(source + "2")
    assert run("cp2", source + "2") == {("a", 2, False), ("b", 1, False), ("z", 1, True)}
