"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, conversations, leaks, neighbours, scans, sentences, splitting
from shelfspark.util import table


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.exact_neighbours(table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.neighbours(table(spark, sf, "chunks")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.complete(table(spark, sf, "messages"))


def p4_threads(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.threads(table(spark, sf, "messages"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.damaged_lines(table(spark, sf, "chunks"))


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired(table(spark, sf, "chunks"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized_ids(p6_pieces(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).distinct()


def p8_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), with_offsets=True)


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(p8_found(spark, sf), table(spark, sf, "benchmark"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "documents"))


def p9_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "documents"), with_text=True)


QUERIES = {"p9_found": p9_found, "p9_sentences": p9_sentences, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_threads": p4_threads, "p5_found": p5_found, "p5_text": p5_text, "p6_pieces": p6_pieces, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_passages": p8_passages, "p8_items": p8_items}

_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200B}\x{FEFF}]"

_NAMES = {k: ", ".join(f"'{n}'" for n in v) for k, v in (("user", conversations.USER), ("assistant", conversations.ASSISTANT), ("system", conversations.SYSTEM))}

_P4 = f"""
with n as (select id, lower(regexp_replace(session_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as session_id, created_at, content,
  lower(regexp_replace(role, '[^\\p{{L}}]+', '', 'g')) as name from messages),
s as (select *, case when name in ({_NAMES["user"]}) then 'user' when name in ({_NAMES["assistant"]}) then 'assistant' when name in ({_NAMES["system"]}) then 'system' else '?' end as speaker from n where session_id is not null and session_id <> ''),
t as (select session_id, speaker, created_at, content, min(id) as id from s where speaker <> 'system' group by all),
o as (select *, row_number() over (partition by session_id order by created_at nulls first, case speaker when 'user' then 0 when 'assistant' then 1 else 2 end, id) as turn from t),
k as (select session_id from o group by session_id having count(*) % 2 = 0 and bool_and(speaker = case turn % 2 when 1 then 'user' else 'assistant' end and created_at is not null
  and coalesce(length(regexp_replace(content, '{_BLANK}+', '', 'g')), 0) > 0))
select session_id, cast(turn as integer) as turn, id from o where session_id in (select session_id from k)
"""

ORACLE = {
    "p4_found": _P4,
    "p6_found": f"select distinct chunk_id from chunks where length(regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g')) > 1000",
}
