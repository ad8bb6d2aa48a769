"""References to records that do not exist: a merge join of references and parents' validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.util import hot_keys, replicated, salted, strip_blank

SALTS = 32


def parent_intervals(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per (table_name, ref_key): whether the parent is there, from when on, and since when it is gone.

    parents: table_name, ref_key, since. deletions: table_name, ref_key, gone_at. A parent that was made
    again after its removal is there. Null keys are dropped. Times may be null. Aggregated on the map side.
    """
    both = parents.select("table_name", "ref_key", F.lit(True).alias("there"), "since", F.lit(None).cast("timestamp").alias("gone_at"))
    both = both.unionByName(deletions.select("table_name", "ref_key", F.lit(False).alias("there"), F.lit(None).cast("timestamp").alias("since"), "gone_at"))
    return both.filter("ref_key is not null").groupBy("table_name", "ref_key").agg(F.max("there").alias("there"), F.min("since").alias("since"), F.max("gone_at").alias("gone_at"))


def broken_references(refs: DataFrame, intervals: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of `refs` (table_name, row_id, ref_key, at) whose reference does not hold, with `kind`.

    missing: the key was never there; deleted: it was removed; late: it is there, but only since after
    `at` (never if a time is null). A null ref_key is no reference. Rows that stand twice count once.

    Both sides are partitioned alike on (table, key, salt), sorted, and merged in one pass. Only keys
    that hold a large share of the references are salted (at most 512 such keys can exist, so their
    list may be broadcast); their interval is repeated for each salt.
    """
    keys = ["table_name", "ref_key"]
    refs = refs.filter("ref_key is not null")
    hot = hot_keys(refs, keys)
    left = salted(refs, hot, keys, F.col("row_id"), salts)
    right = replicated(intervals, hot, keys, salts)
    merged = left.join(right.hint("merge"), [*keys, "_salt"], "left")
    kind = F.when(F.col("there").isNull(), "missing").when(~F.col("there"), "deleted").when(F.col("since") > F.col("at"), "late")
    return merged.withColumn("kind", kind).filter("kind is not null").select("table_name", "row_id", "kind", "at").distinct()


def _id(c: Column) -> Column:
    return strip_blank(c).try_cast("long").cast("string")


def _session(c: Column) -> Column:
    return F.lower(strip_blank(c))


def library_references(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """References of chunks to files and of messages to sessions, in one shape."""
    a = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("row_id"), F.col("file_id").cast("string").alias("ref_key"), F.col("written_at").alias("at"))
    b = messages.select(F.lit("messages").alias("table_name"), F.col("id").alias("row_id"), _session(F.col("session_id")).alias("ref_key"), F.col("created_at").alias("at"))
    return a.unionByName(b)


def library_intervals(files: DataFrame, sessions: DataFrame, deletions: DataFrame) -> DataFrame:
    """Validity intervals of files and sessions, named by the table that refers to them."""
    a = files.select(F.lit("chunks").alias("table_name"), F.col("file_id").cast("string").alias("ref_key"), F.col("indexed_at").alias("since"))
    b = sessions.select(F.lit("messages").alias("table_name"), _session(F.col("session_id")).alias("ref_key"), F.col("created_at").alias("since"))
    d = F.lower(strip_blank(F.col("table_name")))
    gone = deletions.select(
        F.when(d == "files", "chunks").when(d == "sessions", "messages").alias("table_name"),
        F.when(d == "files", _id(F.col("row_key"))).when(d == "sessions", _session(F.col("row_key"))).alias("ref_key"),
        F.col("deleted_at").alias("gone_at"),
    )
    return parent_intervals(a.unionByName(b), gone.filter("table_name is not null"))


def per_month(broken: DataFrame) -> DataFrame:
    """Number of broken references per table, month of the row and kind. A null time has the month null."""
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    return broken.groupBy("table_name", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))
