"""Quality of retrieval and of answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that don't count as key terms. Fixed values.
STOP = "a an the of to in and or for with by on at from as is are was were be been that this which it its into than then their there these those using used use between both each".split()


def key_terms(text: Column) -> Column:
    """Key terms of a text, as a set: words of three signs or more and numbers, without stop words and endings."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:\.[0-9]+)?)"), 1)
    kept = F.filter(found, lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]")) & ~w.isin(STOP))
    return F.array_distinct(F.transform(kept, lambda w: F.when(w.rlike("^[0-9]"), w).otherwise(F.regexp_replace(w, "(ing|ed|es|s)$", ""))))


def retrieval_metrics(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: file_hit, mrr, precision, ctx_recall, rounded to 4 places.

    hits: query_id, rank, path_key, text; truth: query_id, path_key, reference. Queries without hits count 0.
    """
    joined = hits.select("query_id", "rank", F.col("path_key").alias("p"), "text").join(truth, "query_id")
    right = F.col("p") == F.col("path_key")
    per = joined.groupBy("query_id").agg(
        F.min(F.when(right, F.col("rank"))).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(right, 1)).alias("n_right"),
        F.array_distinct(F.flatten(F.collect_list(key_terms(F.col("text"))))).alias("found"),  # the k hits of a query
    )
    want = key_terms(F.col("reference"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return truth.join(per, "query_id", "left").select(
        "query_id",
        F.col("first").isNotNull().alias("file_hit"),
        r(1 / F.col("first")).alias("mrr"),
        r(F.col("n_right") / F.greatest(F.col("n"), F.lit(1))).alias("precision"),
        r(F.size(F.array_intersect(want, F.coalesce("found", F.array().cast("array<string>")))) / F.greatest(F.size(want), F.lit(1))).alias("ctx_recall"),
    )


def totals(per_query: DataFrame) -> DataFrame:
    """Means over the queries: one row."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(c)
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *(mean(c) for c in ("file_hit", "mrr", "precision", "ctx_recall")))


def unanswerable(hits: DataFrame) -> DataFrame:
    """Of questions without an answer: the highest relevance of any best hit (0 without hits). One row."""
    return hits.filter("rank = 1").agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("max_relevance"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit for each element of b."""
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    row = 0
    for x in a:
        both = row | places.get(x, 0)
        row = both & ~(both - (row << 1 | 1))
    return row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words, to 4 places; 0 if either has none or is null."""
    out = []
    for h, r in zip(answer, reference):
        a, b = re.findall(r"\w+", (h or "").lower()), re.findall(r"\w+", (r or "").lower())
        n = lcs_length(a, b) if a and b else 0
        out.append(round(2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)), 4) if n else 0.0)
    return pd.Series(out, dtype="float64")


def write_json(per_query: DataFrame, path: str) -> None:
    """Sink of an evaluation: one JSON object for each query below `path`, numbers and names as in the table."""
    per_query.write.json(path)
