"""Evaluation texts leaking into training text: one Aho-Corasick automaton over all test items."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12

#: Maximal runs of letters and digits.
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words in small letters, as they stand in the original."""
    low = text.lower()
    # where small letters need more characters (as of İ), word by word: marks they bring part no words
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def passages(text: str, n: int = WORDS) -> list[str]:
    """Every run of n words of an item, or all its words if it has fewer; none for a text without words."""
    w = words(text)
    k = min(n, len(w))
    return [" " + " ".join(w[i : i + k]) + " " for i in range(len(w) - k + 1)] if k else []


def patterns(benchmark: DataFrame, n: int = WORDS) -> dict[str, tuple[int, ...]]:
    """Passages with the items they stand in. The benchmark is held-out material: it has to fit into an executor."""
    out: dict[str, set[int]] = {}
    for row in benchmark.select("item_id", "text").filter("text is not null and item_id is not null").distinct().toLocalIterator():
        for p in passages(row.text, n):
            out.setdefault(p, set()).add(row.item_id)
    return {p: tuple(sorted(i)) for p, i in out.items()}


_BUILT: dict[str, object] = {}


def leaks(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, with_offsets: bool = False) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least n consecutive words of an item (or all of
    a shorter item's words); with_offsets adds start and end of the passages from the first to the last in the
    original text (code points) and the number of words from the first to the last.

    Every document is read once, whole, by one automaton over all items; the scan costs the same however many
    items there are. Words are compared in lower case, all between them is ignored. Null and empty texts hold
    nothing. Rows of documents that stand twice give rows twice unless `doc_id` is unique. There is no shuffle.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long" + (", start int, end int, n_words int" if with_offsets else "")
    found = patterns(benchmark, n)
    if not found:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(found)
    key = uuid.uuid4().hex  # a worker builds the automaton once

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = _BUILT.get(key)
        if automaton is None:
            automaton = ahocorasick.Automaton()
            for pattern, items in shared.value.items():
                automaton.add_word(pattern, (len(pattern), items))
            automaton.make_automaton()
            _BUILT.clear()
            _BUILT[key] = automaton
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                normal = " " + " ".join(words(text)) + " "
                spans: dict[int, tuple[int, int]] = {}
                for last, (length, items) in automaton.iter(normal):
                    for item in items:
                        first = spans[item][0] if item in spans else last - length + 1
                        spans[item] = (first, last)
                if spans and with_offsets:
                    where = _offsets(text)
                    rows += [(doc, item, *where(a, b)) for item, (a, b) in spans.items()]
                else:
                    rows += [(doc, item) for item in spans]
            columns = list(zip(*rows)) or [[] for _ in schema.split(",")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return rows.mapInArrow(run, schema)


def _offsets(text: str):
    """From places in the normal text to (start, end, words) in the original one."""
    import bisect

    spans = [m.span() for m in _WORD.finditer(text)]  # the same words, in the original
    starts, at = [], 1
    for w in words(text):
        starts.append(at)
        at += len(w) + 1

    def where(first: int, last: int) -> tuple[int, int, int]:
        i = bisect.bisect_left(starts, first)
        j = bisect.bisect_left(starts, last) - 1
        return spans[i][0], spans[j][1], j - i + 1

    return where


def leaked_items(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Number of documents per leaked test item, with its language and split."""
    n = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return n.join(benchmark.select("item_id", "lang", "split").distinct(), "item_id")
