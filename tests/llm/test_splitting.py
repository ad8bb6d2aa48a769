import random

import numpy as np

from shelfspark.llm import splitting as sp


def whole(text, parts):
    at = 0
    out = ""
    for a, b in parts:
        assert a <= at < b or not text
        out += text[at:b]
        at = b
    return out


def test_range_maximum_equals_brute_force():
    rng = random.Random(5)
    v = np.array([rng.randint(0, 4) for _ in range(400)], np.int8)
    index = sp.RangeMaximum(v, 64)
    for _ in range(500):
        lo = rng.randint(0, 399)
        hi = min(399, lo + rng.randint(0, 63))
        place, strength = index.best(lo, hi)
        assert strength == v[lo : hi + 1].max() and place == max(i for i in range(lo, hi + 1) if v[i] == strength)


def test_pieces_are_whole_and_within_bounds():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Ends here. ", "a, ", "\n", "\n\n", "\f", "x" * rng.randint(1, 90), "第一。", "é̂"]) for _ in range(rng.randint(1, 900)))
        parts = sp.pieces(text)
        assert whole(text, parts) == text and all(0 < b - a <= 1000 for a, b in parts)
        for (a, b), (c, d) in zip(parts, parts[1:]):
            assert 0 <= b - c <= 150 and c > a and d > b


def test_cuts_stand_at_the_strongest_boundary():
    text = "a" * 600 + ". " + "b" * 200 + "\n\n" + "c" * 150 + ". " + "d" * 900
    parts = sp.pieces(text)
    assert text[: parts[0][1]].endswith("b\n\n")
    assert all(text[b - 1] in " .\n" or b - a == 1000 or b == len(text) for a, b in parts)
    assert [b - a for a, b in sp.pieces("y" * 2500)][0] == 1000 and sp.pieces("") == [] and sp.pieces("z" * 1000) == [(0, 1000)]
    marks = "n" + "́" * 3000
    assert whole(marks, sp.pieces(marks)) == marks


def test_overlap_is_as_long_as_the_text_allows():
    for text, least in (("x" * 3000, 150), ("слово" * 900, 150), ("第一頁" * 900, 140), ("Short one. " * 400, 139), ("word " * 800, 145), ("A sentence of a good many words that goes on for about eighty characters or so. " * 40, 70)):
        parts = sp.pieces(text)
        assert all(least <= b - c <= 150 for (_, b), (c, _) in zip(parts, parts[1:])), text[:9]
    marks = "n" + "́" * 3000
    assert all(0 <= b - c <= 150 for (_, b), (c, _) in zip(sp.pieces(marks), sp.pieces(marks)[1:]))


def test_very_long_text_in_blocks():
    text = "Some words stand here. " * 40_000
    parts = sp.pieces(text)
    assert whole(text, parts) == text and all(text[b - 1] == " " for a, b in parts)


def test_table(spark):
    long = "Page one text. " * 50 + "\f" + "Page two text. " * 50
    rows = [(1, long, "S", 3, 4, 9), (1, long, "S", 3, 4, 9), (2, " " * 2000 + "short", None, None, None, 1), (3, "x" * 1000, None, None, None, 1), (4, None, None, None, None, 1), (5, "​﻿" * 900, None, None, None, 1), (6, "k " * 600, None, None, None, 1)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, section string, page_start int, page_end int, piece int")
    got = sp.split_chunks(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {1, 6} and [r.piece for r in got if r.chunk_id == 1] == list(range(sum(r.chunk_id == 1 for r in got)))
    first, last = [r for r in got if r.chunk_id == 1][0], [r for r in got if r.chunk_id == 1][-1]
    assert (first.page_start, first.page_end, last.page_start, last.page_end, first.section) == (3, 3, 3, 4, "S")  # the last begins in the overlap
    assert all(r.text == (long if r.chunk_id == 1 else "k " * 600)[r.start_pos : r.end_pos] for r in got)
    assert {r.chunk_id for r in sp.oversized_ids(sp.split_chunks(df)).collect()} == {1, 6} and sp.split_chunks(df.limit(0)).count() == 0
