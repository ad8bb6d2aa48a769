import os
import random

import pytest

from shelfspark.llm import sentences as se

NAMES = ["Varn", "Ostrek", "Corvel", "Nolvik", "Sandrow", "Mereaux"]
THINGS = ["boiler", "valve", "gate", "pump", "ledger"]


def sentence(rng):
    a, b, n = rng.choice(NAMES), rng.choice(THINGS), rng.randint(1, 60)
    return rng.choice([f"Dr. {a} tested the {b}.", f"The {b} was opened by Mrs. {a}.", "Bring tape, labels, etc.", f"The meeting ended at {n % 12} p.m.", f"See Fig. {n} and No. {n + 3} in the list, p. {n}.", f"It rose from 3.{n} to 9.{n} bar.", f"Who opened the {b}?", f"{a} did.", f"“Is it ready?” asked {a}.", f"The {b} was tested.", f"The {b} broke and was mended in 19{n:02}."])


def foreign(rng):
    return rng.choice([f"温室已由{rng.randint(1, 9)}人核对。", "“先关阀门！”委员会说。", "水泵什么时候到？", "请马上检查！"])


def document(rng):
    paragraphs = [" ".join(sentence(rng) for _ in range(rng.randint(1, 5))) for _ in range(4)]
    paragraphs += ["".join(foreign(rng) for _ in range(rng.randint(1, 4))) for _ in range(2)] + ["สัญญาถูกซ่อมแซม คณะกรรมการเปลี่ยนแบบ"]
    return "\n\n".join(paragraphs)


TRAIN = [document(random.Random(i)) for i in range(400)]


@pytest.fixture(scope="module")
def splitter():
    return se.Splitter(se.train(TRAIN))


def parts(splitter, text):
    out, at = [], 0
    for e in splitter.ends(text):
        a, _ = se._inner(text, at, e)
        out.append(text[a:e])
        at = e
    return out


@pytest.mark.parametrize("want", [
    ["Dr. Varn tested the pump.", "The boiler was opened by Mrs. Corvel."],
    ["Bring tape, labels, etc.", "The meeting ended at 8 p.m.", "It rose from 3.1 to 9.2 bar."],
    ["See Fig. 4 and No. 7 in the list, p. 5.", "Mrs. Nolvik closed the gate."],
    ["“Is it ready?” asked Ostrek.", "Who opened the gate?", "Varn did."],
])
def test_latin(splitter, want):
    assert parts(splitter, " ".join(want)) == want
    text = "\n".join(" ".join(want).rsplit(" ", 2))  # line breaks end nothing
    assert splitter.ends(text) == [sum(len(w) + 1 for w in want[: i + 1]) - 1 for i in range(len(want))]


def test_scripts_without_spaces(splitter):
    assert parts(splitter, "温室已由3人核对。“先关阀门！”委员会说。水泵什么时候到？") == ["温室已由3人核对。", "“先关阀门！”委员会说。", "水泵什么时候到？"]
    assert parts(splitter, "สัญญาถูกซ่อมแซม คณะกรรมการเปลี่ยนแบบ") == ["สัญญาถูกซ่อมแซม", "คณะกรรมการเปลี่ยนแบบ"]


def test_lines(splitter):
    text = "Introduction\nThe pump was tested. It broke\nand was mended.\n\n- First item\n- Second. With two parts.\n# Heading 2\r\n\r\n12. Steps\nLast words without a mark"
    assert parts(splitter, text) == ["Introduction", "The pump was tested.", "It broke\nand was mended.", "- First item", "- Second. With two parts.", "# Heading 2", "12. Steps", "Last words without a mark"]


def test_odd_texts(splitter):
    assert [splitter.ends(t) for t in ("", " \n​﻿  ", "...", "x")] == [[], [], [3], [1]]
    long = "The pump was tested. " * 20_000
    assert len(splitter.ends(long)) == 20_000
    for t in ("?!?! ... 。。 」」", "a.b.c", "\n\n\n.", "“", "\f\x0b"):
        ends = splitter.ends(t)
        assert ends == sorted(set(ends)) and all(0 < e <= len(t) for e in ends)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_paragraph_ends(spark):
    """Reliable boundaries of documents that were not trained on: marks at paragraph ends are found, marks before small letters are not."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [r.text for r in df.filter("text is not null").orderBy("doc_id").collect()]
    splitter = se.Splitter(se.train(texts[:8000]))
    hit = total = wrong = inside = 0
    for text in texts[8000:]:
        ends = set(splitter.ends(text))
        for kind, a, b in se.units(text):
            if kind != "text":
                continue
            for m in se._CANDIDATE.finditer(text, a, b):
                nxt = text[m.end() : b].split(None, 1)
                if m.end() < b and text[m.end()].isspace() and nxt:
                    end = m.end() in ends
                    if nxt[0].strip(".,").islower():
                        inside += 1
                        wrong += end
                    elif text[m.start() - 1].islower() and len(text[a : m.start()].split()[-1]) > 6 and text[a : m.start()].split()[-1].isalpha() and text[m.start()] == "." and m.end() - m.start() == 1:
                        total += 1
                        hit += end
    assert hit > 0.99 * total > 4000 and wrong < 0.01 * inside


def test_tables(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TRAIN)] + [(900, None, None), (901, "", None), (902, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_pos string")
    got = se.sentences(df)
    assert got.columns == ["doc_id", "end_pos"] and got.filter("doc_id >= 900").count() == 0
    full = se.sentences(df, with_text=True).filter("doc_id = 3").orderBy("n").collect()
    assert [r.sentence for r in full] == [TRAIN[3][r.start_pos : r.end_pos] for r in full] and len(full) > 8
    assert se.sentences(df.limit(0)).count() == 0


def test_abbreviations_are_counted_over_all_documents(spark):
    outside = [r.id for r in spark.range(1000, 1400).selectExpr("id", "xxhash64(id) as h").orderBy("h", ascending=False).limit(20).collect()]
    rows = [*enumerate(TRAIN)] + [(i, f"Kapt. {n} closed the gate. We met Kapt. {n}. The pump was tested.") for i, n in zip(outside, NAMES * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any("Kapt." in t for t in se.training_texts(df, 200))
    got = [r.sentence for r in se.sentences(df, with_text=True, sample=200).filter("doc_id >= 1000").collect()]
    assert len(got) == 60 and "Kapt." not in got


def test_headings_are_told_by_context_not_length():
    long = "A considerably longer heading that tells of the Tolvik boiler house and of its many repairs"
    body = "The boiler was checked. Nobody found a fault."
    assert [k for k, _, _ in se.units(f"{long}\n{body}")] == ["heading", "text"]
    assert [k for k, _, _ in se.units(f"{long}\n\n{body}")] == ["heading", "text"]
    wrapped = "The long report on the boiler house and on all of its repairs was sent by the\nTolvik office to the town of Brenn, where it was read by the whole committee at\nHarrow Mill and put away."
    assert [k for k, _, _ in se.units(wrapped)] == ["text"]
    assert [k for k, _, _ in se.units(f"{wrapped}\n\nReport of the Tolvik office\n{wrapped}")] == ["text", "heading", "text"]
