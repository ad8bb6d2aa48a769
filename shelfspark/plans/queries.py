"""Queries of the library's operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import questions as ask
from shelfspark.functions import text as tx
from shelfspark.operators import chunking, history, layout, library, metrics, passages, search
from shelfspark.plans import engine
from shelfspark.plans.sql import ORACLE  # noqa: F401
from shelfspark.util import numbered, table, written

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", tx.tidy(F.col("text")).alias("text"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return library.current_files(table(spark, sf, "files"))


def _chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return library.chunk_rows(table(spark, sf, "chunks"), ["chunk_id", "file_id", *columns])


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their files, as searches read them."""
    files = _files(spark, sf).select("file_id", "path_key", "path", "name", "num_pages")
    return _chunks(spark, sf, "ordinal", "text", "section", "page_start", "page_end", "ocr").join(files, "file_id")


def _read_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, joined once and written: for queries that read them more than once."""
    return written(_docs(spark, sf), "docs")


def _questions(spark: SparkSession, sf: str, every: int = 50) -> DataFrame:
    """Questions whose id is divisible by 50: the stated query set, searched in all rows."""
    m = table(spark, sf, "messages").filter((F.col("id") % every == 0) & F.col("content").isNotNull())
    return m.select(F.col("id").alias("query_id"), F.col("content").alias("text")).distinct()


# text


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query
def tidy_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.tidy(F.col("text"))).alias("digest"))


@query
def search_terms(spark, sf):
    m = table(spark, sf, "messages").select("id", "content").distinct()
    return m.select("id", F.array_join(tx.search_tokens(F.col("content")), " ").alias("terms"))


@query
def token_counts(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return _documents(spark, sf).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query
def heading_lines(spark, sf):
    lines = _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(tx.is_heading(F.col("line"))).select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), tx.strip(F.col("line")).alias("heading"))


def _exploded(df: DataFrame) -> DataFrame:
    rows = df.select("doc_id", F.posexplode("s").alias("n", "s"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("seg_no"), F.md5("s.text").alias("digest"), F.col("s.is_heading").alias("is_heading"))


@query
def line_segments(spark, sf):
    return _exploded(_documents(spark, sf).select("doc_id", tx.line_segments(F.col("text")).alias("s")))


@query
def block_segments(spark, sf):
    return _exploded(_documents(spark, sf).select("doc_id", tx.block_segments(F.col("text")).alias("s")))


@query
def markdown_segments(spark, sf):
    return _exploded(_documents(spark, sf).select("doc_id", tx.block_segments(F.col("text"), True).alias("s")))


@query
def simple_sentences(spark, sf):
    rows = _documents(spark, sf).select("doc_id", F.posexplode(tx.sentence_parts(F.col("text"))).alias("n", "s"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query
def margin_lines(spark, sf):
    pages = _chunks(spark, sf, "text").withColumnRenamed("chunk_id", "page_id").filter("text is not null")
    return passages.margin_lines(pages)


@query
def page_segments(spark, sf):
    pages = _chunks(spark, sf, "text").filter("text is not null").select("file_id", F.col("chunk_id").cast("int").alias("page"), "text")
    return passages.page_segments(pages)


@query
def chunk_documents(spark, sf):
    docs = _documents(spark, sf).select(F.col("doc_id").alias("file_id"), tx.line_segments(F.col("text")).alias("segments"))
    return chunking.chunk_segments(docs)


@query
def embedding_texts(spark, sf):
    d = _docs(spark, sf).filter("text is not null")
    return d.select("chunk_id", F.md5(tx.embedding_text(F.col("name"), F.col("section"), F.col("text"))).alias("digest"), F.md5(tx.passage(F.col("section"), F.col("text"))).alias("passage_digest"))


@query
def page_labels(spark, sf):
    return _chunks(spark, sf, "page_start", "page_end").select("chunk_id", tx.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


@query
def escaped_names(spark, sf):
    return _files(spark, sf).select("path_key", tx.markdown_escape(F.col("name")).alias("escaped"))


@query
def cited_refs(spark, sf):
    m = table(spark, sf, "messages").filter("content is not null").select("id", "content").distinct()
    return m.select("id", F.array_join(F.transform(tx.cited_refs(tx.normal_citations(F.col("content"))), lambda n: n.cast("string")), ",").alias("refs"))


@query
def clean_queries(spark, sf):
    m = table(spark, sf, "messages").filter("content is not null").select("id", "content").distinct()
    return m.select("id", tx.clean_query(F.col("content"), F.lit("?")).alias("query"))


# questions


@query
def page_references(spark, sf):
    m = table(spark, sf, "messages").filter("content is not null").select("id", "content").distinct()
    pages = ask.page_reference(F.col("content"))
    return m.filter(pages.isNotNull()).select("id", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"))


@query
def question_modes(spark, sf):
    m = table(spark, sf, "messages").filter("content is not null").select("id", "content").distinct()
    return m.select("id", ask.mode(F.col("content")).alias("mode"))


# search


@query
def term_statistics(spark, sf):
    return search.term_statistics(search.postings(_docs(spark, sf)))


@query
def bm25_search(spark, sf):
    q = _questions(spark, sf).select("query_id", tx.search_tokens(F.col("text")).alias("terms"))
    return search.bm25(_docs(spark, sf), q).withColumn("score", F.round("score", 6))


@query
def bm25_scoped(spark, sf):
    docs = _docs(spark, sf)
    q = _questions(spark, sf).select("query_id", tx.search_tokens(F.col("text")).alias("terms"))
    scope = docs.filter(library.in_scope(F.col("path_key"), "/library/scans"))
    return search.bm25(docs, q, scope=scope).withColumn("score", F.round("score", 6))


@query
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = e.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return search.vector_search(e, q).withColumn("score", F.round("score", 6))


@query
def vector_topk_scoped(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    q = e.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return search.vector_search(e.filter("label = 3"), q).withColumn("score", F.round("score", 6))


@query
def unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    v = search.normalised(F.col("embedding"))
    return e.select("vec_id", F.round(v[0], 6).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def hashed_words(spark, sf):
    b = table(spark, sf, "benchmark").filter("text is not null").select("item_id", "text").distinct()
    return search.hashed_vectors(b, "item_id", F.col("text")).withColumn("value", F.round("value", 6))


@query
def fused_ranks(spark, sf):
    docs, q = _read_docs(spark, sf), _questions(spark, sf).select("query_id", tx.search_tokens(F.col("text")).alias("terms"))
    words, other = search.bm25(docs, q, 50), search.shared_terms(docs, q, 50)
    return search.fuse(other, words).withColumn("fused", F.round("fused", 9))


@query
def hybrid_search(spark, sf):
    return search.hybrid(_read_docs(spark, sf), _questions(spark, sf)).withColumn("relevance", F.round("relevance", 6))


@query
def rerank_scores(spark, sf):
    docs, q = _read_docs(spark, sf), _questions(spark, sf)
    words = search.bm25(docs, q.select("query_id", tx.search_tokens(F.col("text")).alias("terms")), 30)
    pool = words.select("query_id", "chunk_id", F.col("score").alias("fused"), F.col("rank").alias("place"))
    return search.rerank(pool, q, docs).withColumn("relevance", F.round("relevance", 6))


# scopes, pages, overviews


@query
def scope_files(spark, sf):
    return library.files_by_folder(_files(spark, sf).select("path_key"), table(spark, sf, "folders").select("path_key").distinct())


@query
def chunks_on_pages(spark, sf):
    files = _files(spark, sf).filter("num_pages is not null").select("file_id", F.col("file_id").alias("query_id"), F.array(F.lit(1), F.col("num_pages"), F.floor(F.col("num_pages") / 2).cast("int")).alias("pages"))
    return passages.chunks_on_pages(_chunks(spark, sf, "ordinal", "page_start", "page_end"), files)


@query
def edge_chunks(spark, sf):
    c = _chunks(spark, sf, "ordinal")
    first = passages.edge_chunks(c).withColumn("edge", F.lit("first"))
    return first.unionByName(passages.edge_chunks(c, True).withColumn("edge", F.lit("last")))


@query
def page_answers(spark, sf):
    """Page questions, each put to the file whose number follows from its own: what can be said before reading."""
    m = table(spark, sf, "messages").filter("content is not null").select("id", "content").distinct()
    files = _files(spark, sf)
    last = F.broadcast(files.agg(F.max("file_id").alias("last")))  # one row
    q = m.crossJoin(last).withColumn("file_id", F.col("id") % F.col("last") + 1).join(files.select("file_id", "path_key"), "file_id")
    a = passages.page_answers(q.select(F.col("id").alias("query_id"), "path_key", ask.page_reference(F.col("content")).alias("wanted")), files)
    return a.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query
def overview_spread(spark, sf):
    return passages.spread(_chunks(spark, sf, "ordinal", "section")).select("file_id", "chunk_id", "ordinal")


# the index


@query
def sync_plan(spark, sf):
    from shelfspark.operators.incremental import seen_files

    runs = table(spark, sf, "sync_runs").filter("state = 'done'").agg(F.max("run_id").alias("run_id"))
    found = seen_files(table(spark, sf, "scan_entries").join(F.broadcast(runs), "run_id"))  # one run
    return library.sync_plan(found, _files(spark, sf), retry_ocr=True)


@query
def sync_report(spark, sf):
    return library.sync_report(sync_plan(spark, sf))


@query
def folder_summary(spark, sf):
    return library.folder_summary(_files(spark, sf), table(spark, sf, "folders"))


@query
def folder_issues(spark, sf):
    return library.folder_issues(_files(spark, sf), table(spark, sf, "folders"))


@query
def folder_inventory(spark, sf):
    return library.inventory(_files(spark, sf))


@query
def folder_listing(spark, sf):
    return library.listing(_files(spark, sf), table(spark, sf, "folders"))


@query
def file_states(spark, sf):
    files = _files(spark, sf).select("file_id", "size", F.when(F.col("status") == "error", F.col("error")).alias("error"), "ocr_pages", F.when(F.col("status") == "needs_ocr", 1).otherwise(0).alias("ocr_needed"))
    counts = _chunks(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return library.file_states(files, counts, max_file_mb=50)


# chats and quality


@query
def session_list(spark, sf):
    return history.session_list(table(spark, sf, "sessions")).select("username", "n", "session_id", "mode")


@query
def messages_view(spark, sf):
    v = history.messages_view(table(spark, sf, "messages"))
    return v.groupBy("id", "role").agg(F.max(F.size("citations")).cast("long").alias("n_citations"))


@query
def recent_turns(spark, sf):
    return history.recent_turns(table(spark, sf, "messages")).select("session_id", "n", "id", "role")


@query
def history_text(spark, sf):
    return history.history_text(history.recent_turns(table(spark, sf, "messages"))).select("session_id", F.md5("history").alias("digest"))


@query
def session_titles(spark, sf):
    return history.titles(table(spark, sf, "messages"))


def _hits(spark: SparkSession, sf: str, most: int | None = tx.MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Chunks as questions, with their file as the truth and their whole text as the reference. most: terms searched for."""
    s = table(spark, sf, "chunks").filter("chunk_id % 50 = 0 and file_id is not null and text is not null").select("chunk_id", "file_id", "text").distinct()
    truth = s.join(_files(spark, sf).select("file_id", "path_key"), "file_id").select(F.col("chunk_id").alias("query_id"), "path_key", F.col("text").alias("reference"))
    docs = _read_docs(spark, sf)
    hits = search.bm25(docs, truth.select("query_id", tx.search_tokens(F.col("reference"), most).alias("terms")), 6)
    return hits.join(docs.select("chunk_id", "path_key", "text"), "chunk_id"), truth


@query
def retrieval_metrics(spark, sf):
    return metrics.retrieval_metrics(*_hits(spark, sf, None))


@query
def retrieval_totals(spark, sf):
    return metrics.totals(metrics.retrieval_metrics(*_hits(spark, sf)))


@query
def rouge_l(spark, sf):
    """Every message against the one before it in its session."""
    m = table(spark, sf, "messages").filter("content is not null and session_id is not null").select("id", "session_id", "content").distinct()
    n = numbered(m, "session_id", [F.col("id"), F.col("content")], F.floor(F.col("id") / 4096), "n")
    before = n.select("session_id", (F.col("n") + 1).alias("n"), F.col("content").alias("before"))
    return n.join(before, ["session_id", "n"]).select("session_id", "n", metrics.rouge_l(F.col("content"), F.col("before")).alias("score"))


@query
def ocr_plan(spark, sf):
    """Pages made up from the chunks: their characters, and picture boxes that follow from their ids."""
    box = lambda a, b, c, d: F.struct(*(F.lit(float(x)).alias(n) if not hasattr(x, "cast") else x.cast("double").alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), (a, b, c, d))))
    k = F.col("chunk_id") % 10
    boxes = F.when(k < 2, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")).otherwise(F.array(box(-20, 50, 100 + 60 * k, 500), box(50, 700, 120, 900)))
    c = _chunks(spark, sf, "text").filter("text is not null").select("chunk_id", F.length("text").alias("chars"), layout.clipped(boxes, F.lit(612.0), F.lit(792.0)).alias("boxes"))
    return c.select("chunk_id", layout.ocr_plan(F.col("chars"), F.col("boxes"), F.lit(612.0), F.lit(792.0), F.col("chunk_id") % 7 == 0).alias("plan"))


@query
def layout_lines(spark, sf):
    """Two-column pages made up from the documents' words, read back in order."""
    words = F.filter(F.split(F.regexp_replace("text", tx.WS + "+", " "), " "), lambda w: w != "")
    pages = _documents(spark, sf).select(F.col("doc_id").alias("file_id"), F.lit(1).alias("page"), words.alias("w"))
    place = lambda w, i: F.struct((100.0 + 420 * (i % 2)).alias("x0"), (100.0 + 30 * F.floor(i / 2)).cast("double").alias("y0"), (480.0 + 420 * (i % 2)).alias("x1"), (120.0 + 30 * F.floor(i / 2)).cast("double").alias("y1"), w.alias("text"))
    return layout.layout_lines(pages.select("file_id", "page", F.transform("w", place).alias("boxes")))


@query
def question_answers(spark, sf):
    """The whole pipeline over the question set, all documents in scope."""
    a = engine.answers(_read_docs(spark, sf), _files(spark, sf), _questions(spark, sf), Settings())
    return a.select("query_id", "mode", "status", F.size("citations").alias("n_citations"))
