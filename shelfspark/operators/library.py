"""The library's tables: current rows, scopes, folder rollups, states of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.text import markdown_escape
from shelfspark.operators.incremental import MTIME_TOLERANCE, latest

#: Labels of a file's state. Fixed values.
STATE_LABELS = {"needs_ocr": "scanned, waiting for OCR", "no_text": "no readable text", "error": "couldn't be read", "too_large": "too large, skipped"}

#: Documents listed of a folder, and folders walked. Fixed values.
LISTED, WALKED = 80, 20_000


def current_files(files: DataFrame) -> DataFrame:
    """One row per path_key: the latest by indexed_at. Rows without a path_key are dropped."""
    return latest(files, ["path_key"], ["indexed_at"], [c for c in files.columns if c != "path_key"])


def chunk_rows(chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chunks with a file, copies once."""
    return chunks.select(*columns).filter("chunk_id is not null and file_id is not null").distinct()


def in_scope(path_key: Column, folder: str | None = None, files: Sequence[str] | None = None) -> Column:
    """Under a folder, or one of the files (which go first). A literal prefix, so the scan can use it."""
    if files:
        return path_key.isin(*files)
    if not folder:
        raise ValueError("a scope needs a folder or files")
    return path_key.startswith(folder if folder.endswith("/") else folder + "/")


def ancestors(path_key: Column) -> Column:
    """Every folder above a path, the nearest last: /a/b/c.txt has /a and /a/b."""
    parts = F.split(path_key, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def files_by_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files of each folder, at any depth: a path has few ancestors, so this is an equi-join, not a prefix join."""
    above = files.withColumn("folder_key", F.explode(F.when(F.size(F.split("path_key", "/")) > 2, ancestors(F.col("path_key"))).otherwise(F.array(F.lit("")))))
    return above.join(folders.select(F.col("path_key").alias("folder_key")).distinct(), "folder_key")


def folder_summary(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Per folder: when it was synced, files by state, chunks, and files read by OCR. Folders without files have zeros.

    files: current rows. Counts are combined on the map side.
    """
    of = files_by_folder(files.select("path_key", "status", "num_chunks", "ocr_pages"), folders)
    is_indexed = F.col("status") == "indexed"
    counts = of.groupBy("folder_key").agg(
        F.count(F.when(is_indexed, 1)).alias("files_indexed"),
        F.count("status").alias("files_total"),
        F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("chunks"),
        F.count(F.when(is_indexed & (F.col("ocr_pages") > 0), 1)).alias("files_ocr"),
    )
    synced = folders.groupBy("path_key").agg(F.max("synced_at").alias("synced_at"))
    joined = synced.join(counts, F.col("path_key") == F.col("folder_key"), "left").drop("folder_key")
    return joined.fillna(0, ["files_indexed", "files_total", "chunks", "files_ocr"])


def folder_issues(files: DataFrame, folders: DataFrame, most: int = 50) -> DataFrame:
    """Per folder the first `most` files that aren't indexed, by name and path_key."""
    of = files_by_folder(files.filter("status <> 'indexed'").select("path_key", "path", "name", "status", "error"), folders)
    n = F.row_number().over(W.partitionBy("folder_key").orderBy("name", "path_key"))
    return of.withColumn("n", n).filter(F.col("n") <= most).select("folder_key", "n", "path", "status", "error")


def state_label(status: Column, num_pages: Column, ocr_pages: Column) -> Column:
    """What a listing says of a file; an empty text for an indexed one without pages."""
    pages = F.when(F.coalesce(num_pages, F.lit(0)) != 0, F.concat(num_pages.cast("string"), F.when(num_pages == 1, " page").otherwise(" pages")))
    ocr = F.when(F.coalesce(ocr_pages, F.lit(0)) != 0, F.when(ocr_pages.eqNullSafe(num_pages), "read with OCR").otherwise("partly read with OCR"))
    label = F.when(status.isNull(), "not indexed yet").when(status == "indexed", F.concat_ws(", ", pages, ocr))
    for key, text in STATE_LABELS.items():
        label = label.when(status == key, text)
    return label.otherwise(status)


def inventory(files: DataFrame) -> DataFrame:
    """Rollup of the folder tree: for every folder its documents and subfolders at any depth, and its own documents."""
    paths = files.select("path_key").distinct().filter(F.size(F.split("path_key", "/")) > 2)
    up = paths.select("path_key", ancestors(F.col("path_key")).alias("above"))
    docs = up.select(F.explode("above").alias("folder_key"), F.element_at("above", -1).alias("own"))
    counts = docs.groupBy("folder_key").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("own") == F.col("folder_key"), 1)).alias("n_own"))
    # each folder once, then counted for those above it
    each = up.select(F.explode("above").alias("f")).distinct().filter(F.size(F.split("f", "/")) > 2)
    dirs = each.select(F.explode(ancestors(F.col("f"))).alias("folder_key")).groupBy("folder_key").agg(F.count(F.lit(1)).alias("n_dirs"))
    return counts.join(dirs, "folder_key", "left").fillna(0, ["n_dirs"])


def listing(files: DataFrame, folders: DataFrame, most: int = LISTED) -> DataFrame:
    """Per folder its first `most` documents as list lines, by name in small letters and path_key."""
    of = files_by_folder(files.select("path_key", "name", "status", "num_pages", "ocr_pages"), folders)
    n = F.row_number().over(W.partitionBy("folder_key").orderBy(F.lower("name"), "path_key"))
    label = state_label(F.col("status"), F.col("num_pages"), F.col("ocr_pages"))
    line = F.concat(F.lit("- "), markdown_escape(F.col("name")), F.when(label != "", F.concat(F.lit(" — "), label)).otherwise(""))
    return of.withColumn("n", n).filter(F.col("n") <= most).select("folder_key", "n", line.alias("line"))


def tree(files: DataFrame, folder: str, most: int = LISTED) -> DataFrame:
    """(place, depth, is_folder, line) of the documents below a folder and the folders they stand in, as a tree: at each
    level folders first, then documents, by name in small letters. Only the first `most` documents are listed.

    files: path_key, name, status, num_pages, ocr_pages, once each. Counts of folders are combined on the map side.
    """
    root = folder.rstrip("/")
    below = files.filter(in_scope(F.col("path_key"), root)).withColumn("rest", F.split(F.expr(f"substring(path_key, {len(root) + 2})"), "/"))
    place = lambda parts, last: F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("0"), F.lower(p), F.lit("\x00"), p)), "\x01"), last)
    label = state_label(F.col("status"), F.col("num_pages"), F.col("ocr_pages"))
    own = F.slice("rest", 1, F.size("rest") - 1)
    docs = below.select(
        place(own, F.concat(F.when(F.size("rest") > 1, "\x01").otherwise(""), F.lit("1"), F.lower("name"), F.lit("\x00"), F.col("path_key"))).alias("place"),
        (F.size("rest") - 1).alias("depth"),
        F.lit(False).alias("is_folder"),
        F.concat(markdown_escape(F.col("name")), F.when(label != "", F.concat(F.lit(" — "), label)).otherwise("")).alias("line"),
    )
    prefixes = F.when(F.size("rest") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("rest") - 1)), lambda n: F.slice("rest", 1, n))).otherwise(F.array().cast("array<array<string>>"))
    counts = below.select(F.explode(prefixes).alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("📁 **"), markdown_escape(F.element_at("parts", -1)), F.lit("/** ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " document)").otherwise(" documents)"))
    dirs = counts.select(place(F.col("parts"), F.lit("")).alias("place"), (F.size("parts") - 1).alias("depth"), F.lit(True).alias("is_folder"), name.alias("line"))
    return docs.orderBy("place").limit(most).unionByName(dirs.orderBy("place").limit(WALKED))


def inventory_text(files: DataFrame, folder: str, most: int = LISTED) -> str:
    """What a folder holds, as Markdown. Its documents are counted; the lines are those of `tree`."""
    rows = tree(files, folder, most).orderBy("place").collect()  # `most` documents and WALKED folders at most
    total = files.filter(in_scope(F.col("path_key"), folder)).count()
    escape = str.maketrans({c: "\\" + c for c in "\\`*_[]<>#|"})
    title = folder.rstrip("/").rpartition("/")[2].translate(escape)
    if not total:
        return f"**{title}** has no files that can be read (PDF, Word, text, Markdown or images)."
    folders = sum(r.is_folder for r in rows)
    head = f"**{title}** contains {total} document{'s' * (total != 1)}" + (f" across {folders + 1} folders" if folders else "") + ":"
    lines = [f"{'  ' * r.depth}- {r.line}" for r in rows]
    more = total - sum(not r.is_folder for r in rows)
    return "\n".join([head, "", *lines, *([f"- …and {more} more"] if more else [])])


def file_line(name: Column, path: Column, label: Column) -> Column:
    """What is known of one file, in a chat about it. Fixed texts."""
    where = F.regexp_replace(path, "/[^/]*$", "")
    return F.concat(F.lit("This chat is about one file: **"), markdown_escape(name), F.lit("**"), F.when(label != "", F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(""), F.lit(", in `"), where, F.lit("`."))


def file_texts(files: DataFrame) -> DataFrame:
    """(path_key, text): `file_line` of every file."""
    return files.select("path_key", file_line(F.col("name"), F.col("path"), state_label(F.col("status"), F.col("num_pages"), F.col("ocr_pages"))).alias("text"))


def file_text(files: DataFrame, path_key: str) -> str | None:
    """What is known of one file; None if nothing is."""
    r = file_texts(files.filter(F.col("path_key") == path_key)).first()
    return r and r.text


def other_kinds(found: DataFrame, supported: Sequence[str], most: int = 6) -> DataFrame:
    """The most common extensions among files that can't be read: ext, n."""
    ext = F.lower(F.regexp_extract("path_key", r"[^/.][^/]*?(\.[^./]*)$", 1))
    kinds = found.select(F.when(ext == "", "no extension").otherwise(ext).alias("ext")).filter(~F.col("ext").isin(*[f".{e}" for e in supported]))
    return kinds.groupBy("ext").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(most)


def sync_plan(found: DataFrame, known: DataFrame, retry_ocr: bool = False) -> DataFrame:
    """(path_key, action) of a run over a folder: new, changed, retry, gone or unchanged.

    found: path_key, size, mtime; known: path_key, size, mtime, status; each key once. A full outer join on
    the key; a null or NaN among the compared values counts as a change.
    """
    f, k = found.select("path_key", "size", "mtime").alias("f"), known.select("path_key", "size", "mtime", "status").alias("k")
    same = F.coalesce((F.col("f.size") == F.col("k.size")) & (F.abs(F.col("f.mtime") - F.col("k.mtime")) <= MTIME_TOLERANCE), F.lit(False))
    action = F.when(F.col("f.path_key").isNull(), "gone").when(F.col("k.path_key").isNull(), "new").when(~same, "changed")
    if retry_ocr:
        action = action.when(F.col("k.status") == "needs_ocr", "retry")
    joined = f.join(k, F.col("f.path_key") == F.col("k.path_key"), "full_outer")
    return joined.select(F.coalesce("f.path_key", "k.path_key").alias("path_key"), action.otherwise("unchanged").alias("action"))


def sync_report(plan: DataFrame) -> DataFrame:
    """Counts of a run: files found, to index, removed, unchanged. One row, also for an empty plan."""
    is_ = lambda *a: F.count(F.when(F.col("action").isin(*a), 1))
    return plan.agg(F.count(F.when(F.col("action") != "gone", 1)).alias("files_found"), is_("new", "changed", "retry").alias("to_index"), is_("gone").alias("removed"), is_("unchanged").alias("unchanged"))


def file_states(files: DataFrame, chunk_counts: DataFrame, max_file_mb: int = 100) -> DataFrame:
    """State of each file after reading, from what reading gave: too_large, error, needs_ocr, no_text or indexed.

    files: file_id, size, error, num_pages, ocr_pages, ocr_needed; chunk_counts: file_id, n.
    """
    n = F.coalesce("n", F.lit(0))
    state = F.when(F.col("size") > max_file_mb * 1024 * 1024, "too_large").when(F.col("error").isNotNull(), "error").when((n == 0) & (F.coalesce("ocr_needed", F.lit(0)) > 0), "needs_ocr").when(n == 0, "no_text").otherwise("indexed")
    note = (
        F.when(state == "too_large", F.lit(f"Larger than {max_file_mb} MB"))
        .when(state == "error", F.col("error"))
        .when(state == "needs_ocr", "Scanned, no text layer: OCR is turned off")
        .when(state == "no_text", F.when(F.coalesce("ocr_pages", F.lit(0)) > 0, "No readable text found, even with OCR").otherwise("No extractable text"))
        .when(F.coalesce("ocr_needed", F.lit(0)) > 0, F.concat(F.col("ocr_needed").cast("string"), F.lit(" scanned page(s) skipped: OCR is turned off")))
    )
    return files.join(chunk_counts, "file_id", "left").select("file_id", state.alias("status"), note.alias("note"), n.cast("long").alias("num_chunks"))
