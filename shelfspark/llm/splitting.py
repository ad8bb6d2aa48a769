"""Splitting oversized texts at natural boundaries with a range-maximum index over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.util import BLANK

LIMIT, OVERLAP, LEAST = 1000, 150, 500

#: Boundaries by strength; a cut comes before the place named. Fixed values.
PAGE, PARAGRAPH, HEADING, LINE, SENTENCE, CLAUSE, WORD, SIGN = 8, 7, 6, 5, 4, 3, 2, 1

_RULES = [
    (WORD, re.compile(r"\s+")),
    (WORD, re.compile(r"[぀-ヿ一-鿿฀-ฮ](?=[぀-ヿ一-鿿เ-ไ])")),
    (CLAUSE, re.compile(r"[,;:，、；：،؛–—][\"'”’»）)\]]*\s*")),
    (SENTENCE, re.compile(r"(?:[.!?؟…]+[\"'”’»)\]]*\s+|[。！？।][\"'”’»」』）)\]]*\s*)")),
    (LINE, re.compile(r"[^\S\n\f]*\n[^\S\n\f]*")),
    (HEADING, re.compile(r"\n(?=[^\S\n]*(?:#{1,6} |\d{1,2}(?:\.\d{1,2})*\.? [A-ZÀ-ÞА-Я]))")),
    (PARAGRAPH, re.compile(r"\n[^\S\n\f]*\n\s*")),
    (PAGE, re.compile(r"\s*\f\s*")),
]

#: Signs that belong to the one before them: a hard cut never comes before one.
_JOINED = re.compile(r"[̀-ͯ҃-҉֑-ֽً-ٟऀ-ःऺ-ॏัิ-ฺ็-๎‌‍︎️\U0001f3fb-\U0001f3ff]|(?<=‍).", re.S)


def strengths(text: str) -> np.ndarray:
    """For each place 0..len: how good a cut before it is (0: inside a sign or word)."""
    out = np.zeros(len(text) + 1, np.int8)
    for strength, rule in _RULES:
        ends = np.fromiter((m.end() for m in rule.finditer(text)), np.int64)
        out[ends] = np.maximum(out[ends], strength)
    joined = np.fromiter((m.start() for m in _JOINED.finditer(text)), np.int64)
    out[joined] = -1
    return out


class RangeMaximum:
    """Sparse table over a block of strengths: the strongest place of any window in two look-ups, ties to the right.

    Only windows up to `widest` are asked for, so the table has log2(widest) rows.
    """

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        self.rows = [values.astype(np.int64) * n + np.arange(n)]
        self.n, step = n, 1
        while 2 * step <= min(widest, n):
            a = self.rows[-1]
            self.rows.append(np.maximum(a[: n - 2 * step + 1], a[step : n - step + 1]))
            step *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(place, strength) of the strongest place in lo..hi inclusive."""
        k = (hi - lo + 1).bit_length() - 1
        top = int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]))
        return top % self.n, top // self.n


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces that cover the text, each at most `limit` long.

    A piece ends at the strongest boundary between `least` and `limit` characters after its start; of
    equals at the rightmost. The next begins as far back as `overlap` allows: at the first boundary of a sentence or
    better within the last `overlap` characters, or else at the first word there, or else, where there is no
    boundary at all, right `overlap` characters back, between two signs. A text within the limit is one piece, an
    empty one none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    value = strengths(text)
    block = max(1 << 18, 4 * limit)
    out: list[tuple[int, int]] = []
    start, origin, index = 0, 0, None
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        if index is None or start + limit >= origin + index.n:
            origin = max(0, start - overlap)
            index = RangeMaximum(value[origin : origin + block], limit + 1)
        end, strength = index.best(start + least - origin, start + limit - origin)
        end += origin
        if strength <= 0:  # nothing but one long word: cut it between two signs
            end = start + limit
            while value[end] < 0 and end > start + 1:
                end -= 1
            end = end if end > start + 1 else start + limit
        out.append((start, end))
        lo = max(start + 1, end - overlap)
        back = value[lo:end]
        for good in (SENTENCE, WORD, 0):
            places = np.flatnonzero(back >= good)
            if len(places):
                break
        start = lo + int(places[0]) if len(places) else end


def oversize(text: Column, limit: int = LIMIT) -> Column:
    """More than `limit` code points without outer white space."""
    inner = F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")
    return (F.length(text) > limit) & (F.length(inner) > limit)


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Pieces of every chunk over the limit: chunk_id, piece, start_pos, end_pos, text, section, page_start, page_end.

    Positions are code points of the chunk's text, `text` is exactly that part of it. The pages of a
    piece follow the form feeds before and in it, within those of the chunk (null if the chunk has
    none); the section is the chunk's. Chunks within the limit, null and blank ones have no pieces; a
    chunk that stands several times (exact copies) is split once. The length test runs in the scan;
    only oversized rows are shuffled, to find copies, and go to Python.
    """
    big = chunks.select("chunk_id", "text", "section", "page_start", "page_end").filter(oversize(F.col("text"), limit)).distinct()
    schema = "chunk_id long, piece int, start_pos int, end_pos int, text string, section string, page_start int, page_end int"

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for chunk, text, section, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                feeds = [i for i, c in enumerate(text) if c == "\f"] if "\f" in text else []
                for k, (a, b) in enumerate(pieces(text, limit, overlap, least)):
                    from_page = to_page = None
                    if first is not None:
                        top = last if last is not None else first
                        from_page = min(first + sum(f < a for f in feeds), top)
                        to_page = min(first + sum(f < b - 1 for f in feeds), top) if feeds else top
                    rows.append((chunk, k, a, b, text[a:b], section, from_page, to_page))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = [f.split()[0] for f in schema.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return big.mapInArrow(run, schema)


def oversized_ids(split: DataFrame) -> DataFrame:
    """Chunks that were split."""
    return split.filter("piece = 0").select("chunk_id").distinct()
