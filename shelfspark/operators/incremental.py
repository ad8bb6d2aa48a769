"""Processing only what is new or changed, with the target as the state.

Every row of the target carries the key and the version of the source record it was made from. A run
anti-joins what it sees against the newest published version of the target; what is left is the work.
The next version is written beside the old ones and becomes visible by one atomic rename of a small
marker, so a run that dies at any moment leaves the last published version untouched, and the next
run finds the same work again: nothing is skipped, nothing is done twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MTIME_TOLERANCE = 0.001


class VersionConflict(RuntimeError):
    """Another run published this version first."""


class VersionedTarget:
    """A table in numbered versions. `versions/N.json` names the data of version N; it appears by a rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def info(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A published version (the newest by default); None before the first."""
        have = self.versions()
        if not have:
            return None
        info = self.info(have[-1] if version is None else version)
        return self.spark.read.schema(info["schema"]).parquet(info["data"])

    def labels(self) -> Iterator[tuple[int, str | None]]:
        """(version, label), the newest first."""
        return ((v, self.info(v)["label"]) for v in reversed(self.versions()))

    def publish(self, df: DataFrame, label: str | None = None, expect: int | None = None) -> int:
        """Write `df` as the next version. `expect`: the version this work was based on (0: none)."""
        base = (self.versions() or [0])[-1]
        if expect is not None and expect != base:
            raise VersionConflict(f"based on version {expect}, but {base} is published")
        data = f"{self.root}/data/{base + 1}-{uuid.uuid4().hex}"
        df.write.parquet(data)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        body = json.dumps({"data": data, "schema": schema, "label": label}).encode()
        staged, final = self._path(f"{data}.json"), self._path(f"{self.root}/versions/{base + 1}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(body))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise VersionConflict(f"version {base + 1} was published by another run")
        return base + 1


@dataclass(frozen=True)
class Source:
    """What identifies a record (`key`) and what tells its versions apart.

    exact: columns that must be equal (nulls equal each other); close: columns that may differ by
    their tolerance (a null or NaN on either side counts as a change).
    """

    key: Sequence[str]
    exact: Sequence[str] = ()
    close: Sequence[tuple[str, float]] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.key, *self.exact, *(c for c, _ in self.close)]

    def unchanged(self, new: str, old: str) -> Column:
        both = [F.col(f"{new}.{k}") == F.col(f"{old}.{k}") for k in self.key]
        both += [F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}")) for c in self.exact]
        both += [F.abs(F.col(f"{new}.{c}") - F.col(f"{old}.{c}")) <= F.lit(t) for c, t in self.close]
        out = both[0]
        for c in both[1:]:
            out = out & c
        return out


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The last row of each key by `order` (nulls first), ties by `keep`. One shuffle after a map-side maximum.

    Rows with a null key are dropped. Hot keys do no harm: a partition sends one row for each key.
    """
    rows = df.filter(" and ".join(f"`{k}` is not null" for k in key))
    last = F.max(F.struct(*(F.col(c) for c in dict.fromkeys([*order, *keep]))))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*key, *(F.col(f"_last.{c}").alias(c) for c in keep))


def changed(seen: DataFrame, state: DataFrame | None, source: Source) -> DataFrame:
    """Rows of `seen` without an unchanged counterpart in the state: one left anti join on the key.

    Both sides hold a key once (see `latest`), so no key can be hot. Extra columns of either side
    don't matter, whatever their names; an empty state makes every row new, an empty `seen` gives none.
    """
    if state is None:
        return seen
    return seen.alias("n").join(state.select(*source.columns).alias("o"), source.unchanged("n", "o"), "left_anti")


def run_once(target: VersionedTarget, seen: DataFrame, source: Source, label: str | None = None, process: Callable[[DataFrame], DataFrame] | None = None, keep_unseen: bool = False) -> int:
    """Process what changed since the last published version and publish the next one.

    process: gets the changed rows and returns the rows to store (with the source's columns).
    keep_unseen: rows of the state that the run did not see stay (default: the new state is exactly
    what the run saw). Rows carry `changed`: whether this run had to process them.
    """
    base = (target.versions() or [0])[-1]
    state = target.read()
    todo = changed(seen, state, source)
    made = (process(todo) if process else todo).withColumn("changed", F.lit(True))
    if state is not None:
        old = state.drop("changed")
        kept = old.join(todo.select(*source.key), list(source.key), "left_anti")
        # small differences must not add up over the runs: what was seen is what the next run compares with
        now = seen.select(*source.key, F.struct(*(F.col(c) for c, _ in source.close), F.lit(True).alias("_there")).alias("_now"))
        kept = kept.join(now, list(source.key), "left" if keep_unseen else "inner")
        for c, _ in source.close:
            kept = kept.withColumn(c, F.when(F.col("_now._there"), F.col(f"_now.{c}")).otherwise(F.col(c)))
        made = made.unionByName(kept.select(old.columns).withColumn("changed", F.lit(False)), allowMissingColumns=True)
    return target.publish(made, label, expect=base)


FILES = Source(key=["path_key"], exact=["size"], close=[("mtime", MTIME_TOLERANCE)])


def known_files(files: DataFrame) -> DataFrame:
    """The state before the first run: of each path_key the row with the latest indexed_at."""
    return latest(files, ["path_key"], ["indexed_at"], ["size", "mtime"])


def seen_files(entries: DataFrame) -> DataFrame:
    """What a run saw: of each path_key the entry with the latest seen_at (ties: the later arrival),
    unless its size or mtime is null."""
    rows = latest(entries, ["path_key"], ["seen_at", "entry_id"], ["size", "mtime"])
    return rows.filter("size is not null and mtime is not null")


def replay_runs(files: DataFrame, runs: DataFrame, entries: DataFrame, root: str) -> DataFrame:
    """(run_id, path_key) of every file that a successful run had to process.

    Each run publishes one version under its own label, so a replay that died is taken up behind its last version:
    what was published is read, not done again, and the start state is written once. Runs in another state than
    `done` are not replayed: they published nothing. A row kept from the state carries the mtime of this run,
    since the known state is what it saw.

    The runs table has one row per run over the library, so its ids come to the driver; files and entries never do.
    """
    spark = files.sparkSession
    target = VersionedTarget(spark, root)
    made = {label: version for version, label in target.labels()}
    if "start" not in made:
        target.publish(known_files(files).withColumn("changed", F.lit(False)), label="start", expect=0)
    done = [r.run_id for r in runs.filter("state = 'done' and run_id is not null").select("run_id").distinct().orderBy("run_id").collect()]
    out = None
    for run in done:
        version = made.get(str(run))
        if version is None:
            seen = seen_files(entries.filter(F.col("run_id") == run))
            base = target.versions()[-1]
            todo = changed(seen, target.read(base), FILES).select("path_key").withColumn("changed", F.lit(True))
            state = seen.join(todo, "path_key", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
            version = target.publish(state, label=str(run), expect=base)
        found = target.read(version).filter("changed").select(F.lit(run).cast("long").alias("run_id"), "path_key")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "run_id long, path_key string")
    return out
