import random

import pytest

from shelfspark.llm import scans as sc

WORDS = "the boiler at Holm Pier was opened before noon and every remaining drawing went to storage with some careful notes about timber supplies under supervision"


def text(rng, hurt=False):
    sentences = [" ".join(rng.sample(WORDS.split(), 12)).capitalize() + "." for _ in range(6)]
    if hurt:
        sentences[1] = "Every dr@wing went to storage with some careful notes about tirnber."
    words, lines, line = " ".join(sentences).split(), [], ""
    for w in words:
        if len(line) + 1 + len(w) > 48:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def damaged(rng):
    lines = text(rng, True)
    k = next(i for i in range(2, len(lines) - 1) if lines[i][-1] not in ".,-" and len(lines[i + 1].split()[0]) > 6 and lines[i + 1].split()[0].isalpha() and lines[i + 1].split()[0].islower())
    word = lines[k + 1].split()[0]
    lines[k] += f" {word[:4]}-"
    lines[k + 1] = lines[k + 1][4:]
    lines[k + 1 : k + 1] = ["HOLM  PIER RECORDS    12", "- 12 -", ""]
    return lines, k


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    plain = ["\n".join(text(rng)) for _ in range(240)]
    hurt = []
    while len(hurt) < 6:
        try:
            hurt.append(damaged(rng))
        except StopIteration:
            pass
    return plain, hurt


def repairer(texts, broken=()):
    counted = list(sc.count(iter(texts)))
    words = {k: n for kind, k, n, _ in counted if kind == "w" and n >= 3}
    headers = {k for kind, k, n, m in counted if kind == "l" and m >= 2 and m >= sc.LINE_RATE * n}
    asked = sc.Asked()
    for x in texts:
        asked.add(x)
    asked.broken |= set(broken)
    trie, found = sc.Trie(words), {}
    for w in asked.keys()[0]:
        own = max(words.get(f, 0) for f in sc.counted_as(w))
        rows = sorted(sc.looked_up(w, own, trie, words, max(words.values())), key=lambda r: (r[1], r[0][0].isupper() == w[0].isupper(), r[2], r[0]), reverse=True)
        if rows:
            found[w] = [c for c, k, _ in rows if k > -9 or rows[0][1] == -9]
    return sc.Repairer(words, {w: [(c, found.get(c, [None])[0]) for c in cs] for w, cs in found.items()}, headers)


def test_labels_and_repair(corpus):
    plain, hurt = corpus
    r = repairer(plain + ["\n".join(h) for h, _ in hurt])
    for t in plain:
        _, kinds, _ = r.label(t)
        assert not any(kinds)
    for lines, k in hurt:
        _, kinds, _ = r.label("\n".join(lines))
        assert "hyphen" in kinds[k] and kinds[k + 1] == {"header"} and kinds[k + 2] == {"page_no"}
        for i, line in enumerate(lines):
            assert ("misread" in kinds[i]) == ("dr@wing" in line or "tirnber" in line)
        fixed = r.repair("\n".join(lines))
        assert "HOLM" not in fixed and "drawing" in fixed and "timber" in fixed and "@" not in fixed and "- 12 -" not in fixed and "-" not in fixed


def test_trie_finds_every_word_within_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(13)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(800)}
    trie = sc.Trie(vocabulary)
    for _ in range(150):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        assert sorted(trie.within(w)) == sorted(v for v in vocabulary if distance(v, w) <= 2)


def test_confusions_and_page_numbers():
    assert sc.confused("modern", "rnodem") == 2 and sc.confused("drawing", "dr@wing") == 1 and sc.confused("cat", "car") is None and sc.confused("same", "same") == 0
    for s in ("- 12 -", "Page 3", "Pagc 3", "page 3 of 9", "[7]", "12 |", "xii", "iv", "17", "Seite 4", "p. 9", "3/12", "\f- 2 -"):
        assert sc.is_page_number(s), s
    for s in ("", "1949.", "12 litres", "civil", "Page of notes", "in 1998", "did"):
        assert not sc.is_page_number(s), s


def test_compounds_keep_their_hyphen(corpus):
    plain, _ = corpus
    r = repairer(plain + ["a well-known two-stage pump by Thornley-Vask went to storage with notes"] * 5, [("two", "st@ge"), ("well", "known"), ("Thornley", "Vask"), ("super", "vision"), ("draw", "ing"), ("two", "stage")])
    for a, b, broken in (("two-", "stage", False), ("well-", "known", False), ("Thornley-", "Vask", False), ("super-", "vision", True), ("draw-", "ing", True), ("two-", "st@ge", False)):
        assert r.broken(a[:-1], b) is broken, (a, b)


def test_tables(spark, corpus):
    plain, hurt = corpus
    rows = [(i, t, "c") for i, t in enumerate(plain)] + [(1000 + i, "\n".join(h), "c") for i, (h, _) in enumerate(hurt)]
    rows += [(1000, "\n".join(hurt[0][0]), "c"), (2000, None, None), (2001, "", None), (2002, " \n\f\n", None), (2003, "x" * 100_000, None), (2004, "-\n-\n\n-", None), (2005, "温室\n- 3 -", None)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, kind string")
    got = {(r.chunk_id, r.line_no, r.kind) for r in sc.damaged_lines(df).collect()}
    assert sc.damaged_lines(df).count() == len(got) and {k for _, _, k in got} == {"hyphen", "header", "page_no", "misread"}
    assert (1000, hurt[0][1] + 1, "hyphen") in got and (2005, 2, "page_no") in got and not any(c < 1000 for c, _, _ in got)
    fixed = sc.repaired(df).collect()
    assert len(fixed) == len(rows) - 2 and {r.chunk_id: r.text for r in fixed}[2002] == ""
    assert sc.damaged_lines(df.limit(0)).count() == 0 and sc.repaired(df.limit(0)).count() == 0


def test_what_is_known_does_not_depend_on_the_size_of_the_table(spark):
    many = spark.range(5).selectExpr("repeat('timber ', 1000000) as text")
    few = spark.createDataFrame([("the ledger lay beside the timber under the gate",)] * 4, "text string")
    both = many.unionByName(few).selectExpr("0L as chunk_id", "text")
    words = {r.key: r.n for r in sc.statistics(both).collect()}
    assert words["timber"] == 5_000_004 and words["ledger"] == 4


def test_every_script_and_length_is_checked(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosisuntersuchung"
    plain = [f"важный документ лежит рядом и {long} steht hier daneben" for _ in range(50)]
    hurt = ["важный д0кумент лежит рядом", f"und {long.replace('scopic', 'sc0pic')} steht hier daneben", "важный документ лежит рядом"]
    df = spark.createDataFrame(list(enumerate(plain + hurt)), "chunk_id long, text string")
    assert {(r.chunk_id, r.kind) for r in sc.damaged_lines(df).collect()} == {(50, "misread"), (51, "misread")}
    assert {r.chunk_id: r.text for r in sc.repaired(df).collect()}[50] == "важный документ лежит рядом"


def test_a_running_line_of_one_file_is_known_among_many(spark):
    body = "the boiler was opened before noon and\nBRENN PUMP STATION WEST\nput away again by the crew of the house"
    other = spark.range(20_000).selectExpr("id + 100 as chunk_id", "concat('Heading of number ', id, '\n\nThe crew went home.') as text")
    df = spark.createDataFrame([(i, body) for i in range(3)], "chunk_id long, text string").unionByName(other)
    got = {(r.chunk_id, r.line_no, r.kind) for r in sc.damaged_lines(df).filter("kind = 'header'").collect()}
    assert got == {(i, 2, "header") for i in range(3)}


def test_parts_of_the_vocabulary_and_slices_give_the_same(spark):
    rng = random.Random(2)
    base = {"".join(rng.choice("aeotirnmdl") for _ in range(rng.randint(4, 8))) for _ in range(150)}
    words = {**{w.replace(a, b, 1): 3 for w in base for a, b in (("e", "c"), ("m", "rn"), ("o", "0"))}, **{w: rng.choice([500, 2000]) for w in base}}
    vocabulary = spark.createDataFrame(list(words.items()), "key string, n long")
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    whole = {r.word: [tuple(f) for f in r.found] for r in sc.verdicts(asked, vocabulary).collect()}
    cut = {r.word: [tuple(f) for f in r.found] for r in sc.verdicts(asked, vocabulary, trie=40, lookups=30).collect()}
    assert whole == cut and len(whole) > 20
