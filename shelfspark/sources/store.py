"""The index in a folder that all executors share: files, chunks, folders and settings, in atomic versions.

Chunks are kept in parts, each written by one run. A run adds a part with the chunks of the files it read and a
list of files whose older chunks no longer count; so it writes what changed, never the whole index. `compact`
puts the parts together. A version is a small JSON file that appears by one rename and names all parts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.incremental import VersionConflict
from shelfspark.operators.search import index_of
from shelfspark.util import ranked

FILES = "file_id long, path_key string, path string, name string, ext string, size long, mtime double, status string, error string, num_pages int, num_chunks int, ocr_pages int, indexed_at timestamp"
CHUNKS = "chunk_id long, file_id long, ordinal int, text string, section string, page_start int, page_end int, ocr boolean, embedding array<float>"
POSTINGS = "term string, chunk_id long, len int, f double"
FOLDERS = "path_key string, path string, synced_at timestamp"

#: Chunks of a file get the ids file_id * SPAN + ordinal, so ids are in reading order.
SPAN = 1_000_000


class IndexStore:
    """See above. Ids of files are dense, so with SPAN chunks each there is room for 9 * 10^12 files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self) -> dict:
        """What the newest version holds: files and folders (a path or null), parts, dropped, meta."""
        v = self.version()
        if not v:
            return {"version": 0, "next": 1, "files": None, "folders": None, "parts": [], "postings": [], "dropped": [], "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/versions/{v}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": v}
        finally:
            stream.close()

    def _publish(self, base: dict, **changes) -> int:
        v = base["version"] + 1
        staged, final = self._path(f"{self.root}/staged-{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{v}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({**base, **changes}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise VersionConflict(f"version {v} was published by another run")
        return v

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._read(self.state()["files"], FILES)

    def folders(self) -> DataFrame:
        return self._read(self.state()["folders"], FOLDERS)

    def chunks(self) -> DataFrame:
        """Chunks that count: of each part those of files that no later run dropped."""
        return self._chunks(self.state())

    def postings(self) -> DataFrame:
        """The inverted index of the chunks that count (see `search.index_of`), kept with each part."""
        s = self.state()
        return self._living(s, s["postings"], POSTINGS)

    def _chunks(self, s: dict) -> DataFrame:
        return self._living(s, s["parts"], CHUNKS)

    def _living(self, s: dict, parts: list[str], schema: str) -> DataFrame:
        """Rows of all parts without those of files that a later run dropped."""
        out = self._read(None, schema)
        for i, part in enumerate(parts):
            rows = self._read(part, schema)
            later = [d for k, d in s["dropped"] if k > i]
            if later:
                gone = self.spark.read.schema("file_id long").parquet(*later).withColumnRenamed("file_id", "_file")
                rows = rows.join(gone, F.expr(f"chunk_id div {SPAN}") == F.col("_file"), "left_anti").select(rows.columns)
            out = out.unionByName(rows)
        return out

    def save(self, files: DataFrame, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """Add or replace files (matched by path_key) with all their chunks, and remove those of `gone` (path_key).

        files: the columns of FILES but file_id and num_chunks; chunks: path_key and the columns of CHUNKS but
        chunk_id and file_id, ordinals unique in a file. A file keeps its id; new ones are numbered on from the last
        id that was ever given. A chunk whose file isn't among `files` is an error, and so is one without an ordinal
        or with one of SPAN or more.
        """
        s = self.state()
        old = self._read(s["files"], FILES)
        strays = chunks.join(files, "path_key", "left_anti").unionByName(chunks.filter(f"ordinal is null or ordinal >= {SPAN}")).limit(1).count()
        if strays:
            raise ValueError("chunks without their file or ordinal")
        counts = chunks.groupBy("path_key").agg(F.count(F.lit(1)).cast("int").alias("num_chunks"))
        known = old.select("path_key", "file_id")
        new = files.drop("file_id", "num_chunks").join(known, "path_key", "left").join(counts, "path_key", "left").fillna(0, ["num_chunks"])
        new, following = self._numbered(new, s["next"])
        columns = [c.split()[0] for c in FILES.split(", ")]
        touched = files.select("path_key") if gone is None else files.select("path_key").unionByName(gone.select("path_key"))
        kept = old.join(touched.distinct(), "path_key", "left_anti")
        path = self._write(kept.select(columns).unionByName(new.select(columns)), "files")
        table = self._read(path, FILES)
        ids = table.select("path_key", "file_id")
        numbered = chunks.drop("file_id", "chunk_id").join(ids, "path_key").withColumn("chunk_id", F.col("file_id") * SPAN + F.col("ordinal"))
        part = self._write(numbered.select([c.split()[0] for c in CHUNKS.split(", ")]), "chunks")
        named = self._read(part, CHUNKS).join(table.select("file_id", "name"), "file_id")
        index = self._write(index_of(named).repartitionByRange("term").sortWithinPartitions("term"), "postings")  # sorted: a scan skips other terms
        dropped = self._write(known.join(touched.distinct(), "path_key", "left_semi").select("file_id"), "dropped")
        return self._publish(s, next=following, files=path, parts=[*s["parts"], part], postings=[*s["postings"], index], dropped=[*s["dropped"], [len(s["parts"]), dropped]])

    def _numbered(self, new: DataFrame, first: int) -> tuple[DataFrame, int]:
        """Rows without a file_id get one from `first` on, by path_key; and the first id that is left."""
        ids = ranked(new.filter("file_id is null").select("path_key"), [F.col("path_key")], "_id", first)
        following = ids.agg(F.coalesce(F.max("_id") + 1, F.lit(first)).alias("n")).first().n
        return new.join(ids, "path_key", "left").withColumn("file_id", F.coalesce("file_id", "_id")).drop("_id"), following

    def delete(self, gone: DataFrame) -> int:
        """Remove files (path_key) and their chunks. An empty table changes nothing that can be read."""
        none = self._read(None, FILES)
        return self.save(none, self._read(None, CHUNKS).withColumn("path_key", F.lit("")).limit(0), gone)

    def clear(self) -> int:
        """Remove files and chunks; settings and folders stay."""
        return self._publish(self.state(), files=None, parts=[], postings=[], dropped=[])

    def mark_synced(self, synced: DataFrame) -> int:
        """Add or replace folders: path_key, path, synced_at."""
        s = self.state()
        kept = self._read(s["folders"], FOLDERS).join(synced.select("path_key"), "path_key", "left_anti")
        return self._publish(s, folders=self._write(kept.unionByName(synced), "folders"))

    def meta(self, key: str) -> str | None:
        return self.state()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> int:
        s = self.state()
        return self._publish(s, meta={**s["meta"], key: value})

    def require(self, fingerprint: str) -> bool:
        """Empty an index that was built with other settings. True if it was emptied."""
        if self.meta("fingerprint") == fingerprint:
            return False
        self.clear()
        self.set_meta("fingerprint", fingerprint)
        return True

    def compact(self) -> int:
        """Put all parts together into one."""
        s = self.state()
        index = self._living(s, s["postings"], POSTINGS).repartitionByRange("term").sortWithinPartitions("term")
        return self._publish(s, parts=[self._write(self._chunks(s), "chunks")], postings=[self._write(index, "postings")], dropped=[])
