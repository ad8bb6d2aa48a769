"""Passages by position: pages, edges of a file, and a spread over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.text import line_segments, strip
from shelfspark.operators.layout import page_texts
from shelfspark.util import numbered, written

#: Sections at the end of a document that say nothing of its subject. Fixed pattern.
BACK_MATTER = r"(?i)\b(references|bibliography|acknowledg\w*|appendix|appendices)\b"

PAGE_CHUNKS, EDGE_CHUNKS, BLOCK = 12, 3, 1024


def resolved_pages(wanted: Column, total: Column) -> Column:
    """Positive page numbers: -1 is the last page. Distinct and sorted; page 0 comes out beyond the last page."""
    return F.array_sort(F.array_distinct(F.transform(wanted, lambda p: F.when(p > 0, p).otherwise(total + 1 + p))))


def chunks_on_pages(chunks: DataFrame, wanted: DataFrame, most: int = PAGE_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, n): chunks of a file that overlap any wanted page, by ordinal, the first `most`.

    chunks: file_id, chunk_id, ordinal, page_start, page_end; wanted: query_id, file_id, pages. An equi-join on
    the file; chunks without pages overlap none.
    """
    hit = F.exists("pages", lambda p: (F.col("page_start") <= p) & (F.col("page_end") >= p))
    joined = chunks.filter("page_start is not null and page_end is not null").join(wanted, "file_id").filter(hit)
    n = F.row_number().over(W.partitionBy("query_id").orderBy("ordinal", "chunk_id"))
    return joined.withColumn("n", n).filter(F.col("n") <= most).select("query_id", "chunk_id", "n")


def edge_chunks(chunks: DataFrame, from_end: bool = False, most: int = EDGE_CHUNKS) -> DataFrame:
    """(file_id, chunk_id): the first or last chunks of each file by ordinal. Tasks keep `most` rows of a file before
    the shuffle, so a hot file is no matter."""
    order = [F.desc("ordinal"), F.desc("chunk_id")] if from_end else [F.col("ordinal"), F.col("chunk_id")]
    n = F.row_number().over(W.partitionBy("file_id").orderBy(*order))
    return chunks.select("file_id", "chunk_id", "ordinal").withColumn("n", n).filter(F.col("n") <= most).select("file_id", "chunk_id")


def page_answers(questions: DataFrame, files: DataFrame) -> DataFrame:
    """What can be said of the pages asked for, before any passage is read.

    questions: query_id, path_key, wanted; files: path_key, file_id, name, num_pages. Gives query_id, file_id,
    pages (those there are), edge (first or last: the file has no pages but its edge will do) and message.
    """
    total, wanted = F.col("num_pages"), F.col("wanted")
    pages = resolved_pages(wanted, total)
    there = F.filter(pages, lambda p: (p >= 1) & (p <= total))
    at_end, at_start = F.forall(wanted, lambda p: p < 0), F.forall(wanted, lambda p: p == 1)
    edge = F.when(total.isNull() & (at_end | at_start), F.when(wanted[0] < 0, "last").otherwise("first"))
    asked = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    message = F.when(total.isNull() & edge.isNull(), F.concat("name", F.lit(" has no page numbers (only PDFs and multi-page images do)."))).when(
        total.isNotNull() & (F.size(there) == 0), F.concat("name", F.lit(" has "), total.cast("string"), F.when(total == 1, " page").otherwise(" pages"), F.lit(", so there is no page "), asked, F.lit("."))
    )
    joined = questions.filter("size(wanted) > 0").join(files.select("path_key", "file_id", "name", "num_pages"), "path_key")
    return joined.select("query_id", "file_id", F.when(total.isNotNull(), there).alias("pages"), edge.alias("edge"), message.alias("message"))


def evenly(count: Column, n: Column) -> Column:
    """Places 0..count-1 of n items spread evenly (all if n >= count); halves round to even."""
    every = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    one = F.when(n == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    step = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.bround(j * (count - 1) / F.greatest(n - 1, F.lit(1)), 0).cast("int"))
    return F.when(n >= count, every).when(n <= 1, one).otherwise(step)


def spread(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(file_id, chunk_id, ordinal): k chunks that cover each document, in its order.

    The opening, the first chunks of sections spread evenly, then others spread evenly; back matter only if
    there is nothing else. chunks: file_id, chunk_id, ordinal, section. Chunks are numbered in blocks of
    ordinals, so a hot file is spread over tasks; only its chosen places are joined back.
    """
    order, block = [F.col("ordinal"), F.col("chunk_id")], F.floor(F.col("ordinal") / BLOCK)
    rows = chunks.select("file_id", "chunk_id", "ordinal", "section")
    back = F.coalesce(F.col("section").rlike(BACK_MATTER), F.lit(False))
    rows = rows.withColumn("back", back)
    body = rows.join(rows.groupBy("file_id").agg(F.min("back").alias("only_back")), "file_id").filter(~F.col("back") | F.col("only_back"))
    placed = numbered(body, "file_id", order, block, "i").withColumn("i", F.col("i") - 1)
    before = placed.select("file_id", (F.col("i") + 1).alias("i"), F.col("section").alias("above"), F.lit(True).alias("has"))
    placed = placed.join(before, ["file_id", "i"], "left").withColumn("starts", F.col("has").isNotNull() & ~F.col("section").eqNullSafe(F.col("above")))
    placed = written(placed.select("file_id", "chunk_id", "ordinal", "i", "starts"), "placed")  # read several times below
    size = placed.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count(F.when(F.col("starts"), 1)).cast("int").alias("n_starts"))
    few = placed.join(size.filter(F.col("n") <= k).select("file_id"), "file_id", "left_semi").select("file_id", "chunk_id", "ordinal")
    many = size.filter(F.col("n") > k)
    # which of the section starts, by their number
    starts = numbered(placed.join(many.select("file_id"), "file_id", "left_semi").filter("starts"), "file_id", [F.col("i")], F.floor(F.col("i") / BLOCK), "s")
    picks = many.select("file_id", F.explode(evenly(F.col("n_starts"), F.lit(k - 1))).alias("s")).distinct()
    chosen = written(starts.withColumn("s", F.col("s") - 1).join(picks, ["file_id", "s"]).select("file_id", "i").unionByName(many.select("file_id", F.lit(0).alias("i"))).distinct(), "chosen")
    left = placed.join(many.select("file_id"), "file_id", "left_semi").join(chosen, ["file_id", "i"], "left_anti")
    rest = numbered(left.select("file_id", "i"), "file_id", [F.col("i")], F.floor(F.col("i") / BLOCK), "r").withColumn("r", F.col("r") - 1)
    need = chosen.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("got")).join(many, "file_id")
    fill = need.select("file_id", F.explode(evenly(F.col("n") - F.col("got"), F.lit(k) - F.col("got"))).alias("r")).distinct()
    places = chosen.unionByName(rest.join(fill, ["file_id", "r"]).select("file_id", "i"))
    return few.unionByName(placed.join(places, ["file_id", "i"]).select("file_id", "chunk_id", "ordinal"))


def margin_lines(pages: DataFrame) -> DataFrame:
    """(file_id, line, n): lines that stand at the edge of at least max(3, half) of a file's pages.

    pages: file_id, page_id, text. The edges are the first and last two lines of a page, taken in the scan;
    a line counts once a page. Files of fewer than three pages have none.
    """


    lines = F.split("text", "\n")
    edge = F.array_distinct(F.filter(F.transform(F.concat(F.slice(lines, 1, 2), F.when(F.size(lines) >= 2, F.slice(lines, -2, 2)).otherwise(lines)), strip), lambda s: s != ""))
    counts = pages.select("file_id", F.explode(edge).alias("line")).groupBy("file_id", "line").agg(F.count(F.lit(1)).alias("n"))
    total = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3")
    return counts.join(total, "file_id").filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))).select("file_id", "line", "n")


def page_segments(pages: DataFrame, scanned: bool = False) -> DataFrame:
    """(file_id, n, page, is_heading, text) of files given by page (file_id, page, text): without margin lines and lines
    that are only a number, each page cut to headings and paragraphs; n counts a file's from 0.

    Only the margin lines of a file are put together (a page has four at most that count, and they stand on half of its
    pages, so they are few); its pages stay apart and are numbered in blocks.
    """
    margins = margin_lines(pages.withColumn("page_id", F.col("page"))).groupBy("file_id").agg(F.collect_set("line").alias("margins"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda s: (strip(s) == "") | ~(F.coalesce(F.array_contains("margins", strip(s)), F.lit(False)) | strip(s).rlike(r"^\p{Nd}+$")))
    cut = pages.join(margins, "file_id", "left").select("file_id", "page", line_segments(F.array_join(kept, "\n"), scanned).alias("s"))
    each = cut.select("file_id", "page", F.posexplode("s").alias("k", "s")).select("file_id", "page", "k", F.col("s.is_heading").alias("is_heading"), F.col("s.text").alias("text"))
    placed = numbered(each, "file_id", [F.col("page"), F.col("k")], F.floor(F.col("page") / BLOCK), "n")
    return placed.select("file_id", (F.col("n") - 1).alias("n"), "page", "is_heading", "text")


def scanned_segments(pages: DataFrame) -> DataFrame:
    """(file_id, segments) of scanned pages as an OCR gives them: file_id, page, boxes (array of x0, y0, x1, y1, text).

    Boxes are put in reading order, pages freed of margin lines and cut to headings and paragraphs."""
    return joined_pages(page_segments(page_texts(pages), True), True)


def joined_pages(segments: DataFrame, scanned: bool = False) -> DataFrame:
    """(file_id, segments) of `page_segments`, as the chunker reads documents: a file is one row there."""
    one = F.struct("n", F.struct("text", "is_heading", "page", F.lit(scanned).alias("ocr")).alias("s"))
    return segments.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("p")).select("file_id", F.col("p.s").alias("segments"))
