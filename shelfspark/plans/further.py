"""Further queries over the test tables: the store, chats, and parts of the engine, with their SQL in `further_sql`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as tx
from shelfspark.operators import history, library, metrics, passages, search
from shelfspark.plans import engine
from shelfspark.plans.further_sql import ORACLE  # noqa: F401
from shelfspark.plans.queries import _chunks, _docs, _files, _hits, _questions, _read_docs
from shelfspark.sources.store import CHUNKS, FILES, IndexStore
from shelfspark.util import fresh_dir, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _stored(spark, sf) -> IndexStore:
    """All files with their chunks; then every third file (by size) again with the first two chunks, and every fifth removed."""
    store = IndexStore(spark, fresh_dir(spark, "index"))
    files = _files(spark, sf)
    rows = files.select([c.split()[0] for c in FILES.split(", ") if c.split()[0] not in ("file_id", "num_chunks")])
    own = [c.split()[0] for c in CHUNKS.split(", ") if c.split()[0] not in ("chunk_id", "file_id", "embedding")]
    chunks = _chunks(spark, sf, *own).join(files.select("file_id", "path_key"), "file_id").select("path_key", *own, F.lit(None).cast("array<float>").alias("embedding"))
    store.save(rows, chunks)
    again = rows.filter("size % 3 = 0")
    store.save(again, chunks.filter("ordinal < 2").join(again.select("path_key"), "path_key", "left_semi"))
    store.delete(rows.filter("size % 5 = 0").select("path_key"))
    return store


@query
def scanned_pages(spark, sf):
    """Pages made up from the chunks' lines, one box each in a single column, read back as headings and paragraphs."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda s: s != "")
    place = lambda w, i: F.struct(F.lit(50.0).alias("x0"), (10.0 + 30 * i).cast("double").alias("y0"), F.lit(500.0).alias("x1"), (30.0 + 30 * i).cast("double").alias("y1"), w.alias("text"))
    pages = _chunks(spark, sf, "text").filter("text is not null").select("file_id", F.col("chunk_id").cast("int").alias("page"), F.transform(lines, place).alias("boxes"))
    rows = passages.scanned_segments(pages).select("file_id", F.posexplode("segments").alias("n", "s"))
    return rows.select("file_id", "n", F.col("s.page").alias("page"), F.col("s.is_heading").alias("is_heading"), F.md5("s.text").alias("digest"), F.col("s.ocr").alias("ocr"))


@query
def store_files(spark, sf):
    return _stored(spark, sf).files().select("path_key", "status", "num_chunks")


@query
def store_chunks(spark, sf):
    store = _stored(spark, sf)
    paths = store.files().select("file_id", "path_key")
    return store.chunks().join(paths, "file_id").select("path_key", "ordinal", F.md5("text").alias("digest"), (F.col("chunk_id") % 1_000_000 == F.col("ordinal")).alias("in_order"))


@query
def store_cleared(spark, sf):
    """What is left when the index is emptied since it was built with other settings: settings and folders."""
    store = _stored(spark, sf)
    store.mark_synced(table(spark, sf, "folders").select("path_key", "path", "synced_at").dropDuplicates(["path_key"]))
    store.set_meta("note", "kept")
    emptied = [store.require("one"), store.require("one"), store.require("two")]
    one = spark.createDataFrame([(emptied, store.meta("note"), store.meta("fingerprint"))], "emptied array<boolean>, note string, fingerprint string")
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    counts = n(store.files(), "n_files").crossJoin(n(store.chunks(), "n_chunks")).crossJoin(n(store.folders(), "n_folders"))  # one row each
    return one.crossJoin(counts).select(F.array_join(F.transform("emptied", lambda x: x.cast("string")), ",").alias("emptied"), "note", "fingerprint", "n_files", "n_chunks", "n_folders")


@query
def store_folders(spark, sf):
    """Folders marked as synced, those that never were once more."""
    store = IndexStore(spark, fresh_dir(spark, "index"))
    folders = table(spark, sf, "folders").select("path_key", "path", "synced_at").dropDuplicates(["path_key"])
    store.mark_synced(folders)
    store.mark_synced(folders.filter("synced_at is null").withColumn("synced_at", F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return store.folders().select("path_key", F.date_format("synced_at", "yyyy-MM-dd HH:mm:ss").alias("synced_at"))


def _sessions(spark, sf) -> DataFrame:
    """Each session once, the last used."""
    rows = history.sessions_of(table(spark, sf, "sessions"))
    columns = [c for c in rows.columns if c != "session_id"]
    last = F.max(F.struct("updated_at", *(c for c in columns if c != "updated_at")))
    return rows.groupBy("session_id").agg(last.alias("s")).select("session_id", *(F.col(f"s.{c}") for c in columns))


@query
def sessions_deleted(spark, sf):
    """Sessions and messages left when chats about a file are deleted by their users, and the others by somebody else."""
    s = _sessions(spark, sf)
    gone = s.select("session_id", F.when(F.col("mode") == "file", F.col("username")).otherwise("nobody").alias("username"))
    left, messages = history.delete_sessions(s, table(spark, sf, "messages").select("id", "session_id").distinct(), gone)
    return left.select(F.lit("sessions").alias("kind"), F.col("session_id").alias("key")).unionByName(messages.select(F.lit("messages").alias("kind"), F.col("id").cast("string").alias("key")))


def _exchanged(spark, sf):
    s = _sessions(spark, sf)
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    e = s.filter("mode = 'file'").select("session_id", F.col("title").alias("question"), F.lit("yes").alias("answer"), F.lit("[]").alias("citations"), at.alias("at"))
    return history.add_exchanges(s, table(spark, sf, "messages").select("id", "session_id", "role", "content", "created_at", "citations").distinct(), e, 10**9)


@query
def exchanges_added(spark, sf):
    return _exchanged(spark, sf)[1].filter("id >= 1000000000").select("id", "session_id", "role", "content", "citations")


@query
def sessions_used(spark, sf):
    return _exchanged(spark, sf)[0].select("session_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query
def sessions_changed(spark, sf):
    """A new session for each, but every tenth by its first sign; and another folder for those about a folder."""
    s = _sessions(spark, sf)
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    new = s.select(F.when(F.col("session_id").startswith("a"), F.col("session_id")).otherwise(F.concat(F.lit("n-"), "session_id")).alias("session_id"), F.lit("new").alias("title"), "username", "mode", "folder", "file_path", at.alias("at"))
    made = history.create_sessions(s, new)
    moved = history.set_folders(made, s.filter("mode = 'folder'").select("session_id", F.lit("/elsewhere").alias("folder")))
    return moved.select("session_id", "title", "mode", "folder")


@query
def unanswerable_relevance(spark, sf):
    """The highest relevance among questions taken as ones without an answer."""
    docs, q = _read_docs(spark, sf), _questions(spark, sf)
    found = search.bm25(docs, q.select("query_id", tx.search_tokens(F.col("text")).alias("terms")), 30)
    ranked = search.rerank(found.select("query_id", "chunk_id", F.col("score").alias("fused"), F.col("rank").alias("place")), q, docs)
    return metrics.unanswerable(ranked).select(F.round("max_relevance", 6).alias("max_relevance"))


@query
def metrics_json(spark, sf):
    """Quality per query, written as JSON and read again."""
    path = fresh_dir(spark, "metrics")
    metrics.write_json(metrics.retrieval_metrics(*_hits(spark, sf)), path)
    return spark.read.schema("query_id long, file_hit boolean, mrr double, precision double, ctx_recall double").json(path)


@query
def overview_chunks(spark, sf):
    return engine.overview(_docs(spark, sf)).select("chunk_id", F.col("n").cast("int").alias("n"))


@query
def excerpts(spark, sf):
    docs, q = _read_docs(spark, sf), _questions(spark, sf)
    found = search.bm25(docs, q.select("query_id", tx.search_tokens(F.col("text")).alias("terms")), 6).withColumnRenamed("rank", "ref")
    rows = found.join(docs.select("chunk_id", "name", "text", "section", "page_start", "page_end", "ocr"), "chunk_id")
    return rows.select("query_id", "ref", F.md5(engine.excerpt(rows)).alias("digest"))


@query
def file_texts(spark, sf):
    return library.file_texts(_files(spark, sf))
