"""Chats: sessions, their messages, recent turns, and changes to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.util import is_blank, numbered, ranked

CITATIONS = T.ArrayType(T.StructType([T.StructField("ref", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType())]))


def sessions_of(sessions: DataFrame) -> DataFrame:
    """Sessions once, a null mode as folder, with the time of their last use."""
    rows = sessions.select("session_id", "title", "username", "mode", "folder", "file_path", "created_at", "updated_at").distinct()
    return rows.withColumn("mode", F.coalesce("mode", F.lit("folder"))).withColumn("updated_at", F.coalesce("updated_at", "created_at"))


def session_list(sessions: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions of each user, the last used first: adds `n`. most: only so many for each user; then tasks hand on
    no more. Otherwise they are numbered by day, so a busy user is spread over tasks."""
    rows, order = sessions_of(sessions), [F.col("updated_at").desc_nulls_last(), F.col("session_id")]
    if most:
        n = F.row_number().over(W.partitionBy("username").orderBy(*order))
        return rows.withColumn("n", n).filter(F.col("n") <= most)
    day = F.coalesce(-F.unix_date(F.to_date("updated_at")), F.lit(1 << 30))
    return numbered(rows, "username", order, day, "n")


def view_role(role: Column) -> Column:
    """How a stored role is shown: ai and assistant as assistant, all else (null too) as user."""
    return F.when(role.isin("ai", "assistant"), "assistant").otherwise("user")


def parsed_citations(citations: Column) -> Column:
    """Citations of a message; null and broken JSON as an empty array."""
    return F.coalesce(F.from_json(citations, CITATIONS), F.array().cast(CITATIONS))


def messages_view(messages: DataFrame) -> DataFrame:
    """Messages once, with role as shown and parsed citations."""
    rows = messages.select("id", "session_id", "role", "content", "created_at", "citations").distinct()
    return rows.withColumn("role", view_role(F.col("role"))).withColumn("citations", parsed_citations(F.col("citations")))


def recent_turns(messages: DataFrame, turns: int = 3) -> DataFrame:
    """(session_id, n, id, role, content): the last 2 * turns messages of each session by id, in order.

    Tasks keep so many rows of a session before the shuffle, so a hot session is no matter.
    """
    rows = messages.select("id", "session_id", "role", "content").filter("session_id is not null and id is not null").distinct()
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("id"), F.desc("role"), F.desc("content")))
    last = rows.withColumn("back", back).filter(F.col("back") <= 2 * turns)
    n = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("back")))
    return last.select("session_id", n.alias("n"), "id", view_role(F.col("role")).alias("role"), "content")


def history_text(recent: DataFrame, most: int = 600) -> DataFrame:
    """(session_id, history): recent turns as lines "User: ..." and "Assistant: ...", each cut to `most` signs."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    line = F.concat(who, F.substring(F.coalesce("content", F.lit("")), 1, most), F.when(F.length("content") > most, "…").otherwise(""))
    lines = recent.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))  # 2 * turns at most
    return lines.select("session_id", F.array_join(F.col("lines.line"), "\n").alias("history"))


def titles(messages: DataFrame) -> DataFrame:
    """(session_id, title): the first question of each session, cut to a title. Sessions without one are missing."""
    from shelfspark.functions.text import chat_title

    asked = messages.filter((view_role(F.col("role")) == "user") & F.col("session_id").isNotNull() & ~is_blank(F.col("content")))
    first = asked.groupBy("session_id").agg(F.min(F.struct("id", "content")).alias("f"))
    return first.select("session_id", chat_title(F.col("f.content")).alias("title"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of `gone` (session_id, username) that belong to that user."""
    owned = sessions.join(gone, ["session_id", "username"], "left_semi").select("session_id").distinct()
    return sessions.join(owned, "session_id", "left_anti"), messages.join(owned, "session_id", "left_anti")


def add_exchanges(sessions: DataFrame, messages: DataFrame, exchanges: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Append a question and its answer to sessions and mark these as used.

    exchanges: session_id, question, answer, citations (JSON), at; one for a session. Ids go on from first_id,
    by session_id.
    """
    e = ranked(exchanges, [F.col("session_id")], "n", 0)
    side = lambda role, text, cites, k: e.select((F.lit(first_id) + 2 * F.col("n") + k).cast("long").alias("id"), "session_id", F.lit(role).alias("role"), F.col(text).alias("content"), F.col("at").alias("created_at"), cites.alias("citations"))
    new = side("user", "question", F.lit(None).cast("string"), 0).unionByName(side("ai", "answer", F.col("citations"), 1))
    touched = exchanges.select("session_id", F.col("at").alias("_at"))
    used = sessions.join(touched, "session_id", "left").withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")
    return used, messages.unionByName(new, allowMissingColumns=True)


def create_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Append sessions; ids that are there already stay as they are. new: session_id, title, username, mode, folder,
    file_path, at, once each."""
    rows = new.join(sessions.select("session_id"), "session_id", "left_anti").withColumn("created_at", F.col("at")).withColumn("updated_at", F.col("at")).drop("at")
    return sessions.unionByName(rows, allowMissingColumns=True)


def set_folders(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions with the folder that `changes` (session_id, folder; once each) gives them."""
    to = changes.select("session_id", F.col("folder").alias("_to"), F.lit(True).alias("_set"))
    return sessions.join(to, "session_id", "left").withColumn("folder", F.when(F.col("_set"), F.col("_to")).otherwise(F.col("folder"))).drop("_to", "_set")
