import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.operators import search
from shelfspark.plans.engine import Engine
from shelfspark.sources import files as src
from shelfspark.sources.store import IndexStore

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def par(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


@pytest.fixture()
def library(tmp_path):
    root = tmp_path / "docs"
    for d in ("sub", ".hidden", "node_modules", "_under"):
        (root / d).mkdir(parents=True)
    (root / "notes.txt").write_text("BOILER ROOM NOTES\n\nThe boiler was drained in May. The valve was replaced by Varn.")
    (root / "sub/recipe.md").write_text("# Bread\nMix flour with water and bake the dough.\n")
    table = f'<w:tbl><w:tr><w:tc>{par("Pump")}</w:tc><w:tc>{par("Pump")}</w:tc><w:tc>{par("7 bar")}</w:tc></w:tr></w:tbl>'
    (root / "sub/meeting.docx").write_bytes(docx(par("Agenda", "H1"), par("The committee met on Monday."), table))
    (root / "_under/latin.txt").write_bytes("Café at the pier was closed.".encode("cp1252"))
    for junk in ("data.xlsx", ".hidden/secret.txt", "node_modules/readme.txt", "~$lock.docx", ".dot.txt"):
        (root / junk).write_text("junk")
    (root / "broken.docx").write_text("no zip")
    (root / "scan.pdf").write_bytes(b"%PDF")
    return root


def test_scan_and_read(spark, library):
    found = src.scan_folder(spark, str(library))
    assert sorted(os.path.basename(r.path) for r in found.collect()) == ["broken.docx", "latin.txt", "meeting.docx", "notes.txt", "recipe.md", "scan.pdf"]
    read = {os.path.basename(r.path_key): r for r in src.segments_of(src.read_files(found)).collect()}
    got = {n: [(s.text, s.is_heading) for s in r.segments or []] for n, r in read.items()}
    assert got["notes.txt"] == [("BOILER ROOM NOTES", True), ("The boiler was drained in May. The valve was replaced by Varn.", False)]
    assert got["recipe.md"] == [("Bread", True), ("Mix flour with water and bake the dough.", False)]
    assert got["meeting.docx"] == [("Agenda", True), ("The committee met on Monday.", False), ("Pump | 7 bar", False)]
    assert got["latin.txt"] == [("Café at the pier was closed.", False)]
    assert read["broken.docx"].error.startswith("cannot open DOCX") and read["scan.pdf"].error == "no reader for .pdf"
    listed = {os.path.basename(r.path) for r in src.scan_store(spark, str(library)).collect()}
    assert {"notes.txt", "recipe.md", "meeting.docx"} <= listed and not listed & {"readme.txt", "~$lock.docx", "secret.txt", "data.xlsx"}


def test_sync_is_incremental_and_answers(spark, library, tmp_path):
    pages = lambda data: ([("First page of the scanned ledger.", False, 1, True), ("Last page lists barrels.", False, 2, True)], 2, 0)
    strict = lambda question, text: search.shared_words(question, text) - 3.0  # noqa: E731  (no shared word: below the least relevance)
    engine = Engine(spark, str(tmp_path / "index"), readers={"pdf": pages}, scorer=strict)
    first = engine.sync_folder(str(library))
    assert (first["files_found"], first["to_index"], first["removed"], first["failed"]) == (6, 6, 0, 1)
    assert engine.sync_folder(str(library))["to_index"] == 0
    (library / "notes.txt").write_text("BOILER ROOM NOTES\n\nThe boiler was scrapped in June and nobody missed it at all.")
    (library / "sub/recipe.md").unlink()
    again = engine.sync_folder(str(library))
    assert (again["to_index"], again["removed"]) == (1, 1)
    texts = [r.text for r in engine.store.chunks().collect()]
    assert any("scrapped in June" in t for t in texts) and not any("drained" in t or "dough" in t for t in texts)
    q = spark.createDataFrame([(1, "when was the boiler scrapped"), (2, "zebra xylophone"), (3, "list all files"), (4, "what is on the last page of the scanned ledger"), (5, "what are these documents about"), (6, None)], "query_id long, text string")
    got = {r.query_id: r for r in engine.answer(q, folder=str(library)).collect()}
    assert got[1].status == "no_llm" and got[1].citations[0].file == "notes.txt" and got[1].citations[0].section == "BOILER ROOM NOTES"
    assert got[2].status == "not_found" and got[2].citations == [] and (got[3].mode, got[3].status) == ("inventory", "answered")
    assert got[4].mode == "pages" and got[4].citations[0].file == "scan.pdf" and got[4].citations[0].pages in ("p. 2", "pp. 1–2")
    assert got[5].mode == "overview" and {c.file for c in got[5].citations} == {"latin.txt", "meeting.docx", "notes.txt", "scan.pdf"}
    assert got[3].answer.startswith("**docs** contains 5 documents across 3 folders:\n\n- 📁 **\\_under/** (1 document)\n  - latin.txt\n- 📁 **sub/** (1 document)\n  - meeting.docx\n- broken.docx — couldn't be read\n")
    far = spark.createDataFrame([(1, "page 40 of the scanned ledger"), (2, "zebra xylophone"), (3, "list the files")], "query_id long, text string")
    one = {r.query_id: r for r in engine.answer(far, files=[str(library / "scan.pdf")]).collect()}
    assert (one[1].status, one[1].answer) == ("answered", "scan.pdf has 2 pages, so there is no page 40.") and one[1].citations == []
    assert (one[2].mode, one[2].status) == ("fallback", "no_llm") and one[2].citations and "scan.pdf" in one[3].answer
    retry = Engine(spark, str(tmp_path / "index"), scorer=strict, condenser=lambda q: q.select("query_id", F.col("text").alias("query")), rewriter=lambda d: d.select("query_id", F.lit("when was the boiler scrapped").alias("query")))
    assert {r.query_id: r.status for r in retry.answer(far.filter("query_id = 2"), folder=str(library)).collect()} == {2: "no_llm"}
    said = Engine(spark, str(tmp_path / "index"), scorer=strict, answerer=lambda g: g.select("query_id", F.concat(F.lit("So it is 【1】. "), F.col("excerpts")).alias("answer")))
    a = {r.query_id: r for r in said.answer(q.filter("query_id < 3"), folder=str(library)).collect()}
    assert a[1].answer.startswith("So it is [1]. [1] notes.txt — BOILER ROOM NOTES\n") and 1 in a[1].cited and a[2].answer.startswith("I couldn't find anything relevant")


def test_page_questions_scope_and_errors(spark, library, tmp_path):
    pages = lambda data: ([("First page of the scanned ledger.", False, 1, True), ("Last page lists barrels.", False, 2, True)], 2, 0)
    engine = Engine(spark, str(tmp_path / "index"), readers={"pdf": pages})
    engine.sync_folder(str(library))
    scan, notes = str(library / "scan.pdf"), str(library / "notes.txt")
    assert engine.store.files().filter("name = 'scan.pdf'").first().ocr_pages == 2
    q = spark.createDataFrame([(1, "show me the last page"), (2, "page 40")], "query_id long, text string")
    got = {r.query_id: r for r in engine.answer(q, files=[scan]).collect()}
    assert got[1].mode == "pages" and [c.pages for c in got[1].citations] in (["p. 2"], ["pp. 1–2"])
    assert (got[2].mode, got[2].answer) == ("pages", "scan.pdf has 2 pages, so there is no page 40.")
    assert {r.mode for r in engine.answer(q, files=[scan, notes]).collect()} == {"search"}
    # the corpus counts, not the scope: the order is that of the whole library
    whole = engine.docs()
    wide = {r.chunk_id: r.score for r in search.bm25(whole, spark.createDataFrame([(1, ["the"])], "query_id long, terms array<string>"), 50).collect()}
    part = whole.filter("name = 'notes.txt'")
    some = {r.chunk_id: r.score for r in search.bm25(whole, spark.createDataFrame([(1, ["the"])], "query_id long, terms array<string>"), 50, scope=part.select("chunk_id")).collect()}
    assert some and all(wide[c] == s for c, s in some.items())
    failing = Engine(spark, str(tmp_path / "index"), answerer=lambda g: g.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit("no key").alias("error")))
    r = failing.answer(spark.createDataFrame([(1, "when was the boiler drained")], "query_id long, text string"), folder=str(library)).first()
    assert r.status == "llm_error" and r.answer.startswith("⚠️ no key\n\nHere are") and r.citations and r.cited == []
    # one file by itself
    (library / "notes.txt").write_text("BOILER ROOM NOTES\n\nThe boiler was painted green in July by the whole crew of the house.")
    assert engine.sync_file(notes)["to_index"] == 1 and engine.sync_file(notes)["to_index"] == 0
    assert engine.store.chunks().filter("text like '%painted green%'").first().embedding is not None
    (library / "notes.txt").unlink()
    assert engine.sync_file(notes)["removed"] == 1


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    row = lambda key, status="indexed": (key, key, key, "txt", 1, 1.0, status, None, None, 0, None)
    files = lambda *keys: spark.createDataFrame([row(k) for k in keys], "path_key string, path string, name string, ext string, size long, mtime double, status string, error string, num_pages int, ocr_pages int, indexed_at timestamp")
    chunks = lambda *rows: spark.createDataFrame([(k, o, t, None, None, None, False, None) for k, o, t in rows], "path_key string, ordinal int, text string, section string, page_start int, page_end int, ocr boolean, embedding array<float>")
    texts = lambda: sorted(r.text for r in store.chunks().collect())
    store.save(files("a", "b"), chunks(("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0")))
    store.save(files("a"), chunks(("a", 0, "new")))
    assert texts() == ["b0", "new"] and {r.path_key: r.num_chunks for r in store.files().collect()} == {"a": 1, "b": 1}
    ids = {r.path_key: r.file_id for r in store.files().collect()}
    assert sorted(ids.values()) == [1, 2]
    store.save(files("c", "b"), chunks(("c", 0, "c0"), ("b", 0, "b0")))
    assert {r.path_key: r.file_id for r in store.files().collect()} == {**ids, "c": 3} and {r.chunk_id for r in store.chunks().collect()} == {i * 1_000_000 for i in (1, 2, 3)}
    store.delete(spark.createDataFrame([("c",)], "path_key string"))
    with pytest.raises(ValueError):
        store.save(files("a"), chunks(("zzz", 0, "x")))
    store.delete(spark.createDataFrame([], "path_key string"))
    assert texts() == ["b0", "new"]
    store.delete(spark.createDataFrame([("b",)], "path_key string"))
    store.compact()
    assert texts() == ["new"] and len(store.state()["parts"]) == 1
    store.set_meta("k", "v")
    assert store.meta("k") == "v" and store.meta("other") is None
    assert store.require(Settings().fingerprint()) and not store.require(Settings().fingerprint()) and texts() == [] and store.meta("k") == "v"
