"""Text scalars as Column expressions: cleaning, headings, joining, tokens, labels, citations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any kind.
WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"

#: Section names that are headings by themselves. Fixed values.
KNOWN_SECTIONS = """abstract|introduction|background|related work|prior work|method|methods|methodology|approach|model|architecture|experiments|experiment|experimental setup|experimental results|evaluation|results|results and discussion|discussion|analysis|conclusion|conclusions|future work|limitations|summary|references|bibliography|acknowledgements|acknowledgments|appendix""".split("|")

#: Words that are no search terms. Fixed values.
STOPWORDS = """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your tell explain describe give show find please document documents file files paper""".split()

#: Prefix of a numbered heading: arabic with dots, or roman with a full stop. Fixed value.
NUMBERED = rf"^(?:\d{{1,2}}(?:\.\d{{1,2}})*\.?|[IVX]{{1,5}}\.){WS}+"

MAX_TOKENS = 32


def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with marks, and the letters without."""
    pairs = []
    for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _plain_letters()


#: The characters of WS.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def n_words(c: Column) -> Column:
    """Number of runs without white space."""
    return F.length(F.regexp_replace(F.regexp_replace(c, f"[^{WS[1:-1]}]+", "x"), f"{WS}+", ""))


def _count(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", ""))


def tidy(c: Column) -> Column:
    """Line ends to U+000A, soft hyphens at line ends joined, control characters gone; for text in NFKC already."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    c = F.regexp_replace(c, f"\\x02{WS}*\\n{WS}*", "")
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffe}\x{ffff}]", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean(c: Column) -> Column:
    """NFKC, then `tidy`. Spark has no normalisation, so texts that need it go through Arrow; plain ASCII doesn't."""
    return tidy(F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfkc(c)))


def is_heading(line: Column) -> Column:
    """A short line that is a known section name, all capitals of two words or more, or numbered and capitalised.
    Null for null; false for an empty line."""
    s = strip(line)
    letters = _count(s, r"\p{L}")
    solid = F.length(F.regexp_replace(s, WS, ""))
    core = F.regexp_replace(s, NUMBERED, "")
    known = F.regexp_replace(F.lower(core), ":+$", "").isin(KNOWN_SECTIONS)
    capitals = (letters >= 4) & (n_words(core) >= 2) & (letters >= 0.7 * solid) & (_count(s, r"\p{Lu}") > 0.9 * letters)
    numbered = s.rlike(NUMBERED) & core.rlike(r"^\p{Lu}") & (n_words(core) <= 8)
    # the cheap tests come first: most lines are running text and need no more
    fits = (F.length(s) <= 90) & (F.length(s) >= 3) & ~F.right(s, F.lit(1)).isin(".", ",", ";") & (letters >= 3) & (n_words(s) <= 12) & (letters >= 0.5 * solid)
    return fits & (known | capitals | numbered)


def join_lines(lines: Column, scanned: bool = False) -> Column:
    """An array of lines as one: blank ones skipped, others joined by a space, or by nothing after a hyphen that
    a letter follows; in scanned text that hyphen goes if the letter is small."""
    kept = F.filter(F.transform(lines, strip), lambda s: s != "")
    text = F.array_join(kept, "\n")
    if scanned:
        text = F.regexp_replace(text, r"-\n(\p{Ll})", "$1")
    text = F.regexp_replace(text, r"-\n(\p{L})", "-$1")
    return F.regexp_replace(text, "\n", " ")


_CUT = "\x01"
_HEAD = "\x02"


def _segments(parts: Column, scanned: bool) -> Column:
    """Parts between cuts as (text, is_heading), empty ones dropped."""
    def one(p: Column) -> Column:
        return F.struct(F.when(p.startswith(_HEAD), strip(F.substring(p, 2, 1 << 30))).otherwise(join_lines(F.split(p, "\n"), scanned)).alias("text"), p.startswith(_HEAD).alias("is_heading"))

    return F.filter(F.transform(parts, one), lambda s: s["text"] != "")


def line_segments(text: Column, scanned: bool = False) -> Column:
    """Array of (text, is_heading): headings, and the lines between them or blank lines put together.

    One pass within the row, however many lines: cuts are marked in the text and it is split there.
    """
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda s: F.when(strip(s) == "", F.lit(_CUT)).when(is_heading(s), F.concat(F.lit(_CUT + _HEAD), s, F.lit(_CUT))).otherwise(s))
    return _segments(F.split(F.array_join(marked, "\n"), _CUT), scanned)


def block_segments(text: Column, markdown: bool = False) -> Column:
    """Array of (text, is_heading) of a text file: blocks between blank lines. In plain text a block of a single
    heading line is a heading; in Markdown lines that begin with # are."""
    blocks = F.split(text, f"\n{WS}*\n")
    if markdown:
        pattern = r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"
        marked = F.transform(blocks, lambda b: F.array_join(F.transform(F.split(b, "\n"), lambda s: F.when(s.rlike(pattern), F.concat(F.lit(_CUT + _HEAD), F.regexp_extract(s, pattern, 1), F.lit(_CUT))).otherwise(s)), "\n"))
        return _segments(F.split(F.array_join(marked, _CUT), _CUT), False)

    def one(b: Column) -> Column:
        lines = F.filter(F.split(b, "\n"), lambda s: strip(s) != "")
        head = (F.size(lines) == 1) & is_heading(lines[0])
        return F.struct(F.when(head, strip(lines[0])).otherwise(join_lines(lines)).alias("text"), head.alias("is_heading"))

    return F.filter(F.transform(blocks, one), lambda s: s["text"] != "")


def sentence_parts(text: Column) -> Column:
    """Array of sentences: split after . ! ? before a capital or digit (ASCII), with an opening quote or bracket perhaps."""
    parts = F.split(text, rf"(?<=[.!?]){WS}+(?=[\"'(\[]?[A-Z0-9])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def search_tokens(text: Column, most: int | None = MAX_TOKENS) -> Column:
    """Search terms in order of first use: words in small letters of two signs or more, without stop words. most: None for all."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    return F.array_distinct(kept) if most is None else F.slice(F.array_distinct(kept), 1, most)


def index_tokens(text: Column) -> Column:
    """Words of an indexed text in order, in small letters, marks of letters off, parted also at _."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Mn}", ""), MARKED, UNMARKED)
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def embedding_text(name: Column, section: Column, text: Column) -> Column:
    """What is embedded of a chunk: where it stands, then its text."""
    title = F.translate(stem(name), "_-", "  ")
    header = F.when(F.coalesce(section, F.lit("")) != "", F.concat(title, F.lit(" — "), section)).otherwise(title)
    return F.concat(header, F.lit("\n"), text)


def passage(section: Column, text: Column) -> Column:
    """What a reranker reads of a chunk."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(section, F.lit("\n"), text)).otherwise(text)


def page_label(first: Column, last: Column) -> Column:
    """"p. N", "pp. A–B" or an empty text."""
    span = F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string"))
    return F.when(first.isNull(), "").when((F.coalesce(last, F.lit(0)) != 0) & (last != first), span).otherwise(F.concat(F.lit("p. "), first.cast("string")))


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def normal_citations(c: Column) -> Column:
    """【n】 and 【n†...】 as [n]."""
    return F.regexp_replace(c, r"【(\d+)(?:†[^】]*)?】", "[$1]")


def cited_refs(c: Column) -> Column:
    """Distinct numbers n of [n], sorted; numbers beyond nine digits are none."""
    found = F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def clean_query(c: Column, fallback: Column, most: int = 300) -> Column:
    """A model's reply as a query: its first line without outer quotes, at most 300 signs; else the fallback."""
    line = strip(F.regexp_extract(strip(c), r"^([^\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]*)", 1))
    line = F.regexp_replace(line, '^"+|"+$', "")
    line = strip(F.regexp_replace(line, "^'+|'+$", ""))
    return F.when(F.coalesce(line, F.lit("")) == "", fallback).otherwise(F.substring(line, 1, most))


def chat_title(question: Column) -> Column:
    """At most 60 signs."""
    return F.when(F.length(question) <= 60, question).otherwise(F.concat(F.substring(question, 1, 57), F.lit("…")))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
