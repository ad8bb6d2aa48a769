import random

from shelfspark.llm import leaks

ITEM = "When the Brenn Lock gate was opened in 1931, the crew found twelve sealed crates below the stair."
SHORT = "Who painted it green?"


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = leaks.words(text or "")
        for i, t in items:
            v = leaks.words(t or "")
            n = min(12, len(v))
            if n and any(w[a : a + n] == v[b : b + n] for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "en", "test") for i, t in items], "item_id long, text string, lang string, split string")


def test_equal_to_brute_force(spark):
    rng = random.Random(4)
    vocabulary = "a b c".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 20])))) for i in range(12)] + [(50, None), (51, "?!"), (52, ITEM), (53, SHORT)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "x " + ITEM.upper().replace(" ", " -- ") + " y"), (93, " ".join(ITEM.split()[:12])), (94, " ".join(ITEM.split()[:11])), (95, "who PAINTED\nit… green"), (96, "who painted it greens"), (97, "z " * 50_000 + ITEM)]
    d, b = tables(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, b).collect()} == brute(docs, items)


def test_offsets_point_into_the_original(spark):
    text = "İ ß „Intro”.  When  the BRENN Lock gate was opened, in 1931 the crew found twelve sealed\ncrates! End"
    d, b = tables(spark, [(1, text)], [(7, ITEM)])
    r = leaks.leaks(d, b, with_offsets=True).first()
    assert text[r.start : r.end].startswith("When") and text[r.start : r.end].endswith("crates") and r.n_words == 15


def test_offsets_where_small_letters_are_longer(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = f"İİ İz {item} end of it"
    d, b = tables(spark, [(1, text), (2, f"{item} İ")], [(7, item)])
    got = {r.doc_id: r for r in leaks.leaks(d, b, with_offsets=True).collect()}
    assert text[got[1].start : got[1].end] == item and got[1].n_words == 12 and (got[2].start, got[2].end) == (0, len(item))


def test_copies_and_empty_tables(spark):
    d, b = tables(spark, [(1, ITEM), (2, SHORT)], [(7, ITEM), (8, SHORT), (8, SHORT)])
    assert {tuple(r) for r in leaks.leaks(d, b).collect()} == {(1, 7), (2, 8)}
    assert leaks.leaks(d.limit(0), b).count() == 0 and leaks.leaks(d, b.limit(0)).count() == 0
    assert [(r.item_id, r.n_docs) for r in leaks.leaked_items(leaks.leaks(d, b), b).orderBy("item_id").collect()] == [(7, 1), (8, 1)]
