import pytest
from pyspark.sql import functions as F

from shelfspark.functions import questions as ask
from shelfspark.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("line, head", [("SUMMARY OF WORK", True), ("1. INTRODUCTION", True), ("4.2. Field trials", True), ("Conclusion", True), ("IV. Results of tests", True), ("Discussion:", True), ("We went to the river and", False), ("PUMP", False), ("PUMP 2.5 3.1", False), ("The pump was tested.", False), ("7", False), ("", False), ("  ", False), ("x" * 91, False), ("ÜBER DIE BRÜCKE", True)])
def test_headings(spark, line, head):
    assert one(spark, tx.is_heading(F.col("a")), a=line) is head
    assert one(spark, tx.is_heading(F.col("a")), a=None) is None


def test_cleaning(spark):
    assert one(spark, tx.clean(F.col("a")), a="ﬁ\r\nx\ry\x02 \n z\x00￾ ") == "fi\nx\nyz "
    assert one(spark, tx.clean(F.col("a")), a=None) is None


def test_joining(spark):
    join = lambda s, ocr=False: one(spark, tx.join_lines(F.split("a", "\n"), ocr), a=s)
    assert join("one\n\n two ") == "one two"
    assert join("state-of-the-\nart") == "state-of-the-art"
    assert join("recon-\nstruct", True) == "reconstruct" and join("recon-\nStruct", True) == "recon-Struct" and join("1-\n2") == "1- 2"
    assert join("") == ""


def segments(spark, c, text):
    return [(s.text, s.is_heading) for s in one(spark, c(F.col("a")), a=text)]


def test_segments(spark):
    text = "MAIN PART ONE\nfirst line\nsecond-\nhalf\n\nother\nConclusion\n\n\nend"
    assert segments(spark, tx.line_segments, text) == [("MAIN PART ONE", True), ("first line second-half", False), ("other", False), ("Conclusion", True), ("end", False)]
    assert segments(spark, tx.block_segments, "Conclusion\n\na\nb\n \nMAIN PART ONE\nx") == [("Conclusion", True), ("a b", False), ("MAIN PART ONE x", False)]
    assert segments(spark, lambda c: tx.block_segments(c, True), "# Top ##\ntext\n## Sub\n\nmore") == [("Top", True), ("text", False), ("Sub", True), ("more", False)]
    assert segments(spark, tx.line_segments, "") == [] and segments(spark, tx.block_segments, " \n\n ") == []


def test_sentences_and_terms(spark):
    assert one(spark, tx.sentence_parts(F.col("a")), a='A b. "C d!" (E f)? x. Élan') == ["A b.", '"C d!" (E f)? x. Élan']
    assert one(spark, tx.search_tokens(F.col("a")), a="What's the Pump-house of foo_bar, pump a élan?") == ["pump", "house", "foo_bar", "élan"]
    assert len(one(spark, tx.search_tokens(F.col("a")), a=" ".join(f"w{i}" for i in range(50)))) == 32
    assert one(spark, tx.index_tokens(F.col("a")), a="Foo_bar élan x.txt") == ["foo", "bar", "elan", "x", "txt"]


def test_small_scalars(spark):
    col = F.col("a")
    assert one(spark, tx.normal_citations(col), a="x 【1】 【23†L3-L5】") == "x [1] [23]"
    assert one(spark, tx.cited_refs(col), a="[2] [10] [2] [x]") == [2, 10]
    assert one(spark, tx.clean_query(col, F.lit("raw")), a='\n "pump house" \nmore') == "pump house"
    assert one(spark, tx.clean_query(col, F.lit("raw")), a=' "" ') == "raw" and one(spark, tx.clean_query(col, F.lit("raw")), a=None) == "raw"
    assert one(spark, tx.chat_title(col), a="x" * 61) == "x" * 57 + "…" and one(spark, tx.chat_title(col), a="x" * 60) == "x" * 60
    assert one(spark, tx.markdown_escape(col), a="a_b*c#|[x]`\\") == "a\\_b\\*c\\#\\|\\[x\\]\\`\\\\"
    assert one(spark, tx.embedding_text(col, F.lit("S"), F.lit("t")), a="my_pump-list.v2.txt") == "my pump list.v2 — S\nt"
    assert one(spark, tx.passage(F.lit(None).cast("string"), col), a="t") == "t"
    label = lambda a, b: one(spark, tx.page_label(F.lit(a).cast("int"), F.lit(b).cast("int")), a="")
    assert [label(None, 3), label(2, None), label(2, 2), label(2, 5)] == ["", "p. 2", "p. 2", "pp. 2–5"]


@pytest.mark.parametrize("question, pages", [
    ("show me the final page", [-1]), ("what stands on page 31?", [31]), ("pages 5 to 3 please", [3, 4, 5]), ("pages 3-4", [3, 4]), ("the first page", [1]), ("the 7th page", [7]), ("the third page", [3]),
    ("second to last page", [-2]), ("penultimate page", [-2]), ("last 3 pages", [-3, -2, -1]), ("first two pages", [1, 2]), ("page no. 7", [7]), ("page #12", [12]), ("pages 9 and 4", [4, 9]), ("cover page", [1]),
    ("pp. 10-40", list(range(10, 20))), ("last 99 pages", list(range(-10, 0))), ("page tables of the machine", None), ("what is paging", None), ("how many pages are there", None), ("the last stage of the line", None), ("", None), (None, None),
])
def test_page_references(spark, question, pages):
    assert one(spark, ask.page_reference(F.col("a")), a=question) == pages


@pytest.mark.parametrize("question, mode", [
    ("Give me a summary of page 3", "pages"), ("Summarise this", "overview"), ("what is this document about?", "overview"), ("what are the main points", "overview"), ("walk me through this report", "overview"), ("what does this paper cover", "overview"),
    ("list all the files", "inventory"), ("how many pdfs do I have", "inventory"), ("what's in this folder?", "inventory"), ("which documents mention pumps", "search"), ("list files about pumps", "search"), ("who fixed the pump?", "search"), (None, None),
])
def test_modes(spark, question, mode):
    assert one(spark, ask.mode(F.col("a")), a=question) == mode
