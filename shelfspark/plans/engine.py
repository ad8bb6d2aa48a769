"""The engine: sync folders into an index, and answer tables of questions from it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import questions as ask
from shelfspark.functions.text import cited_refs, embedding_text, normal_citations, page_label
from shelfspark.operators import library, passages, search
from shelfspark.operators.chunking import chunk_segments
from shelfspark.sources import files as sources
from shelfspark.sources.store import IndexStore
from shelfspark.util import written

#: Columns of a hit, as answers cite it.
HIT = ["query_id", "ref", "file", "path", "pages", "page", "section", "snippet", "relevance", "ocr"]


#: What is said where nothing can be answered. Fixed texts.
NOT_FOUND = "I couldn't find anything relevant to that in these documents. Try rephrasing, or check that the right folder is selected and indexed."
NO_LLM = "Add an LLM API key in **Settings** to get a written answer. Meanwhile, these are the most relevant passages I found:"
LLM_ERROR = "⚠️ %s\n\nHere are the most relevant passages I found:"


class Engine:
    """embedder: text -> array<float> as a Column; what it makes of the chunks is kept in the index. scorer: (question, passage) -> logit as a Column, or None to rank by fusion alone; answerer: a function of
    (query_id, question, mode, note, excerpts) rows -> (query_id, answer and, if it failed, error) rows, or None
    without a model. condenser: questions
    (all columns, so a history too) -> (query_id, query), to make follow-ups stand alone; rewriter: (query_id,
    question) of questions for which nothing relevant was found -> (query_id, query) to try once more."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), scorer: Callable[[Column, Column], Column] | None = search.shared_words, answerer: Callable[[DataFrame], DataFrame] | None = None, readers: dict | None = None, condenser: Callable[[DataFrame], DataFrame] | None = None, rewriter: Callable[[DataFrame], DataFrame] | None = None, embedder: Callable[[Column], Column] = search.hashed_words):
        self.spark, self.settings, self.scorer, self.answerer, self.readers = spark, settings, scorer, answerer, readers
        self.condenser, self.rewriter, self.embedder = condenser, rewriter, embedder
        self.store = IndexStore(spark, root)
        self.store.require(settings.fingerprint())

    def sync_folder(self, folder: str) -> dict:
        """Index what is new or changed below a folder and remove what is gone; counts of the run.

        An embedder that can't be used fails before anything is read or written.
        """
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"Folder not found: {folder}")
        folder = os.path.abspath(folder)
        report = self._sync(sources.scan_folder(self.spark, folder), self.store.files().filter(library.in_scope(F.col("path_key"), folder)))
        self.store.mark_synced(self.spark.createDataFrame([(folder, folder)], "path_key string, path string").withColumn("synced_at", F.current_timestamp()))
        return report

    def sync_file(self, path: str) -> dict:
        """The same for one file, whatever folder it is in; one that is gone is removed."""
        path = os.path.abspath(path)
        found = sources.scan_folder(self.spark, os.path.dirname(path)).filter(F.col("path") == path)
        return self._sync(found, self.store.files().filter(F.col("path_key") == os.path.normcase(path)))

    def check_models(self) -> None:
        """Embed a word, so that a model that can't be loaded is known at once."""
        self.spark.createDataFrame([("word",)], "w string").select(self.embedder(F.col("w")).alias("v")).collect()

    def _sync(self, found: DataFrame, known: DataFrame) -> dict:
        plan = library.sync_plan(found, known, retry_ocr=bool(self.readers)).persist()
        report = library.sync_report(plan).first().asDict()
        if report["to_index"]:
            self.check_models()
        todo = found.join(plan.filter("action in ('new', 'changed', 'retry')").select("path_key"), "path_key", "left_semi")
        read = sources.segments_of(sources.read_files(todo, self.readers, self.settings.max_file_mb)).persist()
        keyed = read.withColumn("file_id", F.xxhash64("path_key"))
        title = F.element_at(F.split("path_key", "/"), -1)
        cut = chunk_segments(keyed.select("file_id", "segments"), self.settings).join(keyed.select("file_id", "path_key"), "file_id").drop("file_id")
        cut = written(cut.withColumn("embedding", self.embedder(embedding_text(title, F.col("section"), F.col("text"))).cast("array<float>")), "chunks")
        counts = cut.groupBy("path_key").agg(F.count(F.lit(1)).alias("n"))
        by_ocr = F.filter("segments", lambda x: x["ocr"])
        ocr_pages = F.coalesce(F.size(F.array_distinct(F.transform(by_ocr, lambda x: F.coalesce(x["page"], F.lit(1))))), F.lit(0))
        ocr_pages = F.when(F.col("segments").isNull(), 0).otherwise(ocr_pages)
        states = library.file_states(read.select(F.col("path_key").alias("file_id"), "size", "error", "num_pages", ocr_pages.alias("ocr_pages"), "ocr_needed"), counts.withColumnRenamed("path_key", "file_id"), self.settings.max_file_mb)
        rows = read.join(states.withColumnRenamed("file_id", "path_key").drop("num_chunks"), "path_key").join(todo.select("path_key", "path"), "path_key")
        name = F.element_at(F.split("path", "/"), -1)
        files = rows.select("path_key", "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "size", "mtime", "status", F.col("note").alias("error"), "num_pages", ocr_pages.alias("ocr_pages"), F.current_timestamp().alias("indexed_at"))
        if report["to_index"] or report["removed"]:
            self.store.save(files, cut, plan.filter("action = 'gone'").select("path_key"))
        report["failed"] = files.filter("status = 'error'").count()
        read.unpersist()
        plan.unpersist()
        return report

    def docs(self) -> DataFrame:
        """Chunks with their file: what searches read."""
        files = self.store.files().select("file_id", "path_key", "path", "name", "num_pages")
        return self.store.chunks().drop("embedding").join(files, "file_id")

    def answer(self, questions: DataFrame, folder: str | None = None, files: list[str] | None = None) -> DataFrame:
        """(query_id, mode, status, answer, citations) of a table of questions (query_id, text), all in one scope.

        Rows of questions are distinct by query_id; a null text is a question without terms. See `answers`.
        """
        everything, inside = self.docs(), library.in_scope(F.col("path_key"), folder, files)
        docs, known = everything.filter(inside), self.store.files().filter(inside)
        vectors = self.store.chunks().select("chunk_id", F.col("embedding").alias("v"))
        out = answers(docs, known, questions, self.settings, self.scorer, self.answerer, files, self.condenser, self.rewriter, everything, self.embedder, vectors, self.store.postings())
        if not route(questions).filter("other = 'inventory'").limit(1).count():
            return out
        text = library.file_text(known, files[0]) if files else library.inventory_text(known, folder)
        return out.withColumn("answer", F.when(F.col("mode") == "inventory", F.lit(text or "I couldn't list that.")).otherwise(F.col("answer")))


def route(questions: DataFrame) -> DataFrame:
    """Adds wanted (the pages a question, or what is searched for, asks for) and other, its mode if it is not for pages."""
    text = F.coalesce("text", F.lit(""))
    wanted = ask.page_reference(text)
    if "query" in questions.columns:
        wanted = F.coalesce(wanted, ask.page_reference(F.coalesce("query", F.lit(""))))
    other = F.when(ask.is_overview(text), "overview").when(ask.is_inventory(text), "inventory").otherwise("search")
    return questions.withColumn("wanted", wanted).withColumn("other", other)


def passages_for(docs: DataFrame, files: DataFrame, questions: DataFrame, settings: Settings = Settings(), scorer=search.shared_words, scope: list[str] | None = None, corpus: DataFrame | None = None, embedder=search.hashed_words, vectors: DataFrame | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, chunk_id, ref, relevance, mode) of the passages each question is answered from; (query_id, message)
    of page questions of which there are none; and the questions with their mode. questions: query_id, text and, if
    it differs, query, what is searched for.

    docs and files are those in scope; scope: the files by name, if a chat is about some. corpus: all documents,
    whose statistics count. Page questions are about the one file of the scope or, in a folder, the file of the best
    hit, and take the chunks on those pages; about several files, or without a hit, they are like any other.
    Overview questions take up to 4 relevant hits and a spread over the documents; the others the best hits.
    """
    routed = written(route(questions), "routed")
    searched = questions.select("query_id", F.col("query" if "query" in questions.columns else "text").alias("text"))
    hits = written(search.hybrid(docs, searched, settings, scorer=scorer, corpus=corpus, embedder=embedder, vectors=vectors, index=index), "hits")  # read by every branch below
    file_of = docs.select("chunk_id", "file_id", "path_key")
    paging = routed.filter("wanted is not null").select("query_id", "wanted")
    if scope:
        target = paging.withColumn("path_key", F.lit(scope[0])).limit(10**9 if len(scope) == 1 else 0)
    else:
        target = hits.filter("rank = 1").join(paging, "query_id").join(file_of, "chunk_id").select("query_id", "path_key", "wanted")
    found = target.select("query_id", F.lit("pages").alias("_mode"))
    routed = routed.join(found, "query_id", "left").withColumn("mode", F.coalesce("_mode", "other")).drop("_mode", "other")
    plain = hits.join(routed.filter("mode = 'search'").select("query_id"), "query_id").select("query_id", "chunk_id", F.col("rank").alias("ref"), "relevance")
    # pages
    asked = passages.page_answers(target, files)
    spans = docs.select("file_id", "chunk_id", "ordinal", "page_start", "page_end")
    on_pages = passages.chunks_on_pages(spans, asked.filter("message is null and pages is not null").select("query_id", "file_id", "pages"))
    ends = passages.edge_chunks(spans, True).withColumn("edge", F.lit("last")).unionByName(passages.edge_chunks(spans).withColumn("edge", F.lit("first")))
    at_edge = asked.filter("edge is not null").select("query_id", "file_id", "edge").join(ends, ["file_id", "edge"])
    n = F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id"))
    paged = on_pages.select("query_id", "chunk_id", F.col("n").alias("ref")).unionByName(at_edge.select("query_id", "chunk_id", n.alias("ref"))).withColumn("relevance", F.lit(None).cast("double"))
    # overviews
    about = routed.filter("mode = 'overview'").select("query_id")
    matched = hits.join(about, "query_id").filter((F.col("rank") <= 4) & (F.col("relevance").isNull() | (F.col("relevance") >= settings.min_relevance)))
    opening = overview(docs, settings.overview_chunks)
    wide = about.crossJoin(F.broadcast(opening))  # overview_chunks rows at most
    first = matched.select("query_id", "chunk_id", F.col("rank").alias("o"), "relevance")
    rest = wide.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", (F.col("n") + 4).alias("o"), F.lit(None).cast("double").alias("relevance"))
    both = first.unionByName(rest)
    spread = both.withColumn("ref", F.row_number().over(W.partitionBy("query_id").orderBy("o"))).drop("o")
    parts = plain.withColumn("mode", F.lit("search")).unionByName(paged.withColumn("mode", F.lit("pages"))).unionByName(spread.withColumn("mode", F.lit("overview")))
    empty = F.concat(F.lit("Page "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(" of "), F.col("name"), F.lit(" has no readable text: it may be blank, a picture without words, or handwriting OCR couldn't read."))
    unread = asked.filter("message is null and pages is not null").join(on_pages.select("query_id").distinct(), "query_id", "left_anti").join(files.select("file_id", "name"), "file_id").select("query_id", empty.alias("message"))
    return parts, asked.filter("message is not null").select("query_id", "message").unionByName(unread), routed


def overview(docs: DataFrame, most: int = 10) -> DataFrame:
    """(chunk_id, n): at most `most` chunks that cover the documents of a scope, files by name.

    Each of the first files has its share: most / number of files, at least one chunk. Only the first `most` files
    by name are spread, so the work is bounded by them.
    """
    files = docs.groupBy("file_id").agg(F.min(F.struct("name", "ordinal", "chunk_id")).alias("first"))
    n_files = files.count()
    share = max(1, most // max(1, n_files))
    leading = files.orderBy("first").limit(most).select("file_id", "first")
    rows = docs.select("file_id", "chunk_id", "ordinal", "section").join(leading.select("file_id"), "file_id", "left_semi")
    picked = passages.spread(rows, share).join(leading, "file_id")
    n = F.row_number().over(W.orderBy("first", "ordinal", "chunk_id"))  # most * share rows at most
    return picked.withColumn("n", n).filter(F.col("n") <= most).select("chunk_id", "n")


def folder_note(found: DataFrame, docs: DataFrame, n_files: int) -> DataFrame:
    """(query_id, note): how many of a folder's files the passages of each question come from, unless it is all."""
    shown = found.join(docs.select("chunk_id", "file_id"), "chunk_id").groupBy("query_id").agg(F.countDistinct("file_id").alias("n"))
    return shown.filter(F.col("n") < n_files).select("query_id", F.concat(F.lit(" (they come from "), F.col("n").cast("string"), F.lit(f" of the {n_files} files in the folder)")).alias("note"))


def answers(docs: DataFrame, files: DataFrame, questions: DataFrame, settings: Settings = Settings(), scorer=search.shared_words, answerer=None, scope: list[str] | None = None, condenser=None, rewriter=None, corpus: DataFrame | None = None, embedder=search.hashed_words, vectors: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The whole pipeline: route, retrieve, judge the evidence, answer, cite.

    status: answered, not_found (no passage is relevant enough), no_llm (passages, but no answerer) or llm_error (the
    answerer gave an error: the passages are cited without an answer). A question for pages that aren't there is
    answered by saying so. In a chat about files (scope) there is always an answer: without evidence from an
    overview (mode fallback). rewriter: see Engine; the second search counts unless the first was better.
    """
    if condenser is not None:
        made = condenser(questions).select("query_id", F.col("query").alias("_q"))
        questions = questions.join(made, "query_id", "left").withColumn("query", F.coalesce("_q", "text")).drop("_q")
    by_files = bool(scope)
    retrieve = lambda q: passages_for(docs, files, q, settings, scorer, scope, corpus, embedder, vectors, index)
    parts, notes, routed = retrieve(questions)
    found, notes, routed = written(parts, "passages"), written(notes, "notes"), written(routed, "routed")
    best_of = lambda rows: rows.groupBy("query_id").agg(F.min(F.struct("ref", F.coalesce("relevance", F.lit(1.0)).alias("r"))).alias("t")).select("query_id", F.col("t.r").alias("top"))
    top = best_of(found)
    if rewriter is not None:
        doubt = routed.join(top, "query_id", "left").filter((F.col("mode") == "search") & (F.coalesce("top", F.lit(-1.0)) < settings.min_relevance))
        again = doubt.select("query_id", "text").join(rewriter(doubt.select("query_id", F.col("text").alias("question"))).select("query_id", "query"), "query_id")
        second = written(retrieve(again)[0], "passages")
        better = best_of(second).withColumnRenamed("top", "new").join(top, "query_id", "left").filter(F.col("new") >= F.coalesce("top", F.lit(-1.0))).select("query_id")
        found = written(found.join(better, "query_id", "left_anti").unionByName(second.join(better, "query_id", "left_semi")), "passages")
        top = best_of(found)
    judged = routed.join(top, "query_id", "left").withColumn("top", F.coalesce("top", F.lit(-1.0))).join(notes, "query_id", "left")
    evident = F.col("top") >= settings.not_found_relevance
    if by_files:
        weak = judged.filter(~evident & (F.col("mode") == "search")).select("query_id")
        wide = weak.crossJoin(F.broadcast(overview(docs, settings.overview_chunks)))  # overview_chunks rows at most
        found = found.join(weak, "query_id", "left_anti").unionByName(wide.select("query_id", "chunk_id", F.col("n").alias("ref"), F.lit(None).cast("double").alias("relevance"), F.lit("fallback").alias("mode")))
        judged = judged.withColumn("mode", F.when(~evident & (F.col("mode") == "search"), "fallback").otherwise(F.col("mode")))
    listed = (F.col("mode") == "inventory") | F.col("message").isNotNull()
    status = F.when(listed, "answered").when(evident | F.lit(by_files), "answered" if answerer else "no_llm").otherwise("not_found")
    state = judged.select("query_id", "mode", "text", "top", "message", status.alias("status"))
    rows = found.join(docs.select("chunk_id", "path", "name", "text", "section", "page_start", "page_end", "ocr"), "chunk_id")
    cites = rows.select("query_id", "ref", F.col("name").alias("file"), "path", page_label(F.col("page_start"), F.col("page_end")).alias("pages"), F.col("page_start").alias("page"), "section", F.substring("text", 1, settings.snippet_chars).alias("snippet"), "relevance", "ocr")
    per = cites.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*HIT[1:]))).alias("citations"))  # 14 at most
    out = state.join(per, "query_id", "left")
    empty = F.array().cast(per.schema["citations"].dataType)
    out = out.withColumn("citations", F.when((F.col("status") == "not_found") | (F.col("mode") == "inventory") | F.col("message").isNotNull(), empty).otherwise(F.coalesce("citations", empty)))
    none, missing = F.lit(None).cast("string"), F.when(F.col("status") == "not_found", NOT_FOUND).when(F.col("status") == "no_llm", NO_LLM)
    if answerer is None:
        out = out.withColumn("answer", F.coalesce("message", missing))
    else:
        texts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ref", excerpt(rows).alias("block")))).alias("b"))  # 14 at most
        given = out.filter("status = 'answered' and mode <> 'inventory' and message is null").join(texts, "query_id")
        if not by_files:
            given = given.join(folder_note(found.filter("mode = 'overview'"), docs, files.count()), "query_id", "left")
        else:
            given = given.withColumn("note", none)
        said = answerer(given.select("query_id", F.col("text").alias("question"), "mode", "note", F.array_join("b.block", "\n\n").alias("excerpts")))
        error = F.col("error") if "error" in said.columns else none
        said = said.select("query_id", normal_citations(F.col("answer")).alias("said"), error.alias("error"))
        out = out.join(said, "query_id", "left").withColumn("status", F.when(F.col("error").isNotNull(), "llm_error").otherwise(F.col("status")))
        failed = F.format_string(LLM_ERROR, F.col("error"))
        out = out.withColumn("answer", F.when(F.col("error").isNotNull(), failed).otherwise(F.coalesce("message", missing, "said")))
    cited = F.when(F.col("status") == "answered", F.coalesce("answer", F.lit(""))).otherwise("")
    return out.select("query_id", "mode", "status", "answer", "citations", cited_refs(cited).alias("cited"))


def excerpt(rows: DataFrame) -> Column:
    """A passage as a model reads it: [n] name — pages — section — scanned text (OCR), then the text."""
    label = page_label(F.col("page_start"), F.col("page_end"))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    where = F.concat_ws(" — ", some(F.col("name")), some(label), some(F.col("section")), F.when(F.col("ocr"), "scanned text (OCR)"))
    return F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "), where, F.lit("\n"), F.coalesce("text", F.lit("")))
