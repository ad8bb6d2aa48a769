"""Overlapping chunks of whole sentences that begin anew at headings.

A document is a row of units, sentences and headings, with the sums of their lengths before each. A chunk is a run
of units from one place to another, so cutting is a walk over places: where a run must end follows from the sums,
and where the next begins is a search in them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import Settings

SECTION_CHARS = 200

#: Where a sentence ends: after . ! ? before a capital or a digit. Fixed pattern.
_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")

CHUNK_SCHEMA = "ordinal int, text string, section string, page_start int, page_end int, ocr boolean"


class Unit(NamedTuple):
    """A sentence or a heading, with where it stands."""

    text: str
    page: int | None = None
    section: str | None = None
    heading: bool = False
    ocr: bool = False


def fitted(sentence: str, limit: int) -> list[str]:
    """A sentence in parts of at most `limit`, at words where it can be; words beyond the limit are cut."""
    if len(sentence) <= limit:
        return [sentence]
    words = [w[i : i + limit] for w in sentence.split() for i in range(0, len(w), limit)]
    ends = list(accumulate(len(w) + 1 for w in words))  # each with the blank behind it
    out, at = [], 0
    while at < len(words):
        begin = ends[at - 1] if at else 0
        stop = bisect_right(ends, begin + limit + 1)
        out.append(" ".join(words[at:stop]))
        at = stop
    return out


def units(segments: Iterable[tuple[str, bool, int | None, bool]], limit: int) -> list[Unit]:
    """Headings and sentences of (text, is_heading, page, ocr)."""
    out: list[Unit] = []
    section = None
    for text, heading, page, ocr in segments:
        section = text[:SECTION_CHARS] if heading else section
        parts = [text] if heading else [p for s in map(str.strip, _BOUNDARY.split(text)) if s for p in fitted(s, limit)]
        out += (Unit(p, page, section, heading, ocr) for p in parts)
    return out


def runs(found: list[Unit], size: int, overlap: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the units of each chunk. See `chunks`."""
    sums = list(accumulate((len(u.text) + 1 for u in found), initial=0))
    headings = [i for i, u in enumerate(found) if u.heading]
    first = fresh = 0  # where the chunk begins, and where what no chunk had before begins
    for i, u in enumerate(found):
        held = sums[i] - sums[first]
        starts = u.heading and held >= least
        drops = u.heading and first < i == fresh  # there is nothing but overlap before the heading
        over = first < i and sums[i + 1] - sums[first] > size
        if starts or over and not drops:
            yield first, i
        if starts or drops:
            first = fresh = i
        elif over:
            behind = bisect_left(headings, i)
            first = max(headings[behind - 1] + 1 if behind else 0, first, bisect_left(sums, sums[i] - 1 - overlap, 0, i))
            fresh = i
    yield first, len(found)


def _chunk(part: list[Unit]) -> tuple:
    """(text, section, page_start, page_end, ocr): a heading stands on a line of its own, sentences after a blank."""
    text = "".join(f"\n{u.text}\n" if u.heading else u.text if not k or part[k - 1].heading else f" {u.text}" for k, u in enumerate(part)).strip()
    section = next((u.section for u in reversed(part) if u.heading), None) or next((u.section for u in part if u.section), None)
    pages = [u.page for u in part if u.page is not None] or [None]
    return text, section, min(pages), max(pages), any(u.ocr for u in part)


def chunks(segments: Iterable[tuple[str, bool, int | None, bool]], size: int = 1000, overlap: int = 150, least: int = 300) -> Iterator[tuple]:
    """Chunks (ordinal, text, section, page_start, page_end, ocr) of a document's segments.

    A heading closes a chunk that has at least `least` characters, and drops a mere overlap; a unit that
    doesn't fit closes the chunk too, and the last units up to the overlap, back to a heading, begin the next.
    Headings alone make no chunk. The section is the last heading's in the chunk, or else the first unit's.
    """
    found = units(segments, max(100, size - overlap))
    parts = (found[a:b] for a, b in runs(found, size, overlap, least))
    return ((n, *_chunk(p)) for n, p in enumerate(p for p in parts if not all(u.heading for u in p)))


def chunk_segments(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_id, ordinal, text, section, page_start, page_end, ocr) of documents.

    docs: file_id, segments (array of text, is_heading and, if there, page and ocr). A document is one row,
    so there is no shuffle. Documents without text have no chunks; ids that stand twice are cut twice.
    """
    fields = docs.schema["segments"].dataType.elementType.names
    schema = "file_id long, " + CHUNK_SCHEMA
    s = settings

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for file, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [(x["text"], bool(x["is_heading"]), x.get("page"), bool(x.get("ocr"))) for x in segments or () if x and x["text"]]
                rows += [(file, *c) for c in chunks(parts, s.chunk_chars, s.chunk_overlap_chars, s.min_chunk_chars)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    keep = F.transform("segments", lambda x: F.struct(*(x[n].alias(n) for n in fields if n in ("text", "is_heading", "page", "ocr"))))
    return docs.select(F.col("file_id").cast("long").alias("file_id"), keep.alias("segments")).mapInArrow(run, schema)
