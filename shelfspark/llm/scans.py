"""Noise in text from scanned pages: page furniture, words broken across lines, and misread characters.

One pass counts, over all texts, how often every word stands and how often every short line stands where a
running line would. A second puts the texts into groups and notes of each group what it asks: which words it
has to judge, and which lines. What is asked is looked up by joins, each word once; then every group
goes together with its answers, and the lines of each text are labelled and repaired: page furniture goes, broken
words are joined, misread words are replaced, and lines are put together to paragraphs. Nothing that grows
with the vocabulary is broadcast or sent to the driver.

Candidates for a misread word are all vocabulary words within an edit distance: a Levenshtein automaton of
the word is run against a trie of the vocabulary, so none is missed. The vocabulary is cut into tries of a
bounded size, and every word asked for meets each of them. Candidates are ranked by what scanners confuse,
by how common they are and by whether they stand elsewhere in the same text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.util import written

#: A word is known if it stands so often, whatever the size of the table.
LEAST = 3

#: A short line is a running line if it stands at this rate where one would.
LINE_RATE = 0.25

#: A word is held to be a misreading of one that is so many times as common.
RATIO = 40

#: Counts held by a task before it hands them on.
FLUSH = 400_000

#: Characters of the texts of a group (a longer text is one by itself), words of a trie, and words that one task looks up.
GROUP, TRIE, LOOKUPS = 1_000_000, 50_000, 500

#: Up to this width one line tells how wide a text is wrapped; a wider one must be full twice and go on.
NARROW, FULL = 120, 0.75

#: What scanners make of letters: (right, wrong). Fixed values.
CONFUSIONS = [("e", "c"), ("E", "F"), ("i", "!"), ("n", "ri"), ("a", "@"), ("A", "@"), ("t", "+"), ("o", "0"), ("O", "0"), ("s", "5"), ("s", "$"), ("S", "5"), ("S", "$"), ("d", "cl"), ("l", "1"), ("l", "|"), ("I", "l"), ("I", "1"), ("i", "1"), ("I", "|"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("cl", "d"), ("g", "9"), ("h", "li"), ("b", "8"), ("B", "8"), ("w", "vv"), ("c", "e"), ("Z", "2"), ("z", "2"), ("о", "0"), ("О", "0"), ("з", "3"), ("З", "3"), ("б", "6"), ("ч", "4")]

HYPHENS = "-\xad¬‐"
_TERMINAL = re.compile(r"[.!?…:;。！？।؟]['\"”’“»」』）)\]]*$")
_ITEM = re.compile(r"(?:[-*•‣–—]|\(?\d{1,3}[.)]|#{1,6})\s+\S")
_TABLE = re.compile(r"\S(?:\t|\s{2,})\S.*(?:\t|\s{2,})\S|^\|.*\|$")
_NUMBER = r"[\dlIOo|!]{0,4}\d[\dlIOo|!]{0,4}|[lIO|!]"
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$", re.I)
_PAGE = re.compile(rf"(?:[-–—~]\s*(?:{_NUMBER})\s*[-–—~]|\[\s*(?:{_NUMBER})\s*\]|\(\s*(?:{_NUMBER})\s*\)|(?:{_NUMBER})\s*\||\|\s*(?:{_NUMBER})|\d{{1,4}}(?:\s*/\s*\d{{1,4}})?|第\s*\d+\s*[页頁])$")
_PAGE_WORD = re.compile(rf"(page|pages|seite|p\.|pg\.|s\.|pag\.|pág\.|pagina|página|стр\.)\s*(?:{_NUMBER})(?:\s*(?:of|von|de|sur|out of|из|/)\s*(?:{_NUMBER}))?$")
_SIDE_NUMBER = re.compile(rf"^(?:{_NUMBER})\s{{2,}}(?=\S*[^\W\d_])|(?<=\S)\s{{2,}}(?:{_NUMBER})$")
_OUTER = "\"'“”„«»()[]¿¡‘’.,;:?…"
_WORD_LIKE = re.compile(r"[^\W_]|[!@$+|\-'’]")
_LETTER = re.compile(r"[^\W\d_]")
_FOLD_PAIRS = [("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("rn", "m")]
_FOLD_PAIRS_2 = [("ri", "n"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("rn", "m")]  # for pairs that overlap, as in "riits"
_FOLD_SIGNS = str.maketrans({"!": "i", "1": "l", "|": "l", "0": "o", "5": "s", "$": "s", "@": "a", "+": "t", "9": "g", "8": "b", "о": "o", "з": "3", "б": "6", "ч": "4"})
_FOLD_LETTERS = str.maketrans({"c": "e", "f": "e"})


def fold(line: str, pairs: list[tuple[str, str]] = _FOLD_PAIRS) -> str:
    """The same for a line and its misreadings: confused characters become one."""
    s = line.lower().translate(_FOLD_SIGNS)
    for wrong, right in pairs:
        s = s.replace(wrong, right)
    return s.translate(_FOLD_LETTERS)


_PAGE_NAMES = {fold(w): w for w in ("page", "seite", "pages", "pagina", "página")}


def is_page_number(line: str) -> bool:
    s = line.strip()
    if not s or len(s.split(None, 5)) > 5:
        return False
    if _PAGE.match(s) or _ROMAN.match(s):
        return True
    low = s.lower()
    if _PAGE_WORD.match(low):
        return True
    head, _, rest = low.partition(" ")
    return fold(head) in _PAGE_NAMES and bool(_PAGE_WORD.match("page " + rest))


def skeleton(line: str, pairs: list[tuple[str, str]] = _FOLD_PAIRS) -> str:
    """A running line without its page number, blanks and numbers made alike, misreadings folded."""
    s = _SIDE_NUMBER.sub("", line.strip())
    return fold(" ".join("#" if w.strip(",.;").isdigit() else w for w in s.split()), pairs)


def _open_end(line: str) -> bool:
    """The line can go on in the next one."""
    return not _TERMINAL.search(line)


def _side_number(s: str) -> bool:
    return ("  " in s or "\t" in s) and bool(_SIDE_NUMBER.search(s))


class Lines:
    """Lines of a text with what is known of each without counts: blank, page, item, table, short or text."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.line = [x.strip() for x in self.raw]
        self.kind = [self._kind(s) for s in self.line]
        # a broken word may stand beyond the width
        widest = max([len(s) for s, k in zip(self.line, self.kind) if k == "text" and s[-1] not in HYPHENS and not _side_number(s)], default=0)
        n = len(self.line)
        full = widest <= NARROW or sum(k == "text" == after and len(s) >= FULL * widest for s, k, after in zip(self.line, self.kind, self.kind[1:])) > 1
        self.width = widest if full else 0  # 0: the text isn't wrapped
        self.short = 0.7 * widest if widest > 100 else 70
        for i, (s, k) in enumerate(zip(self.line, self.kind)):
            if k == "text" and self._short(i, s, n):
                self.kind[i] = "short"

    @staticmethod
    def _kind(s: str) -> str:
        if not s:
            return "blank"
        if is_page_number(s):
            return "page"
        if _ITEM.match(s) and not s[0].isdigit():
            return "item"
        if "  " in s or "\t" in s or s[0] == "|":
            if not _side_number(s) and _TABLE.search(s):
                return "table"
        return "text"

    def _short(self, i: int, s: str, n: int) -> bool:
        """A line that was not broken because it was full, and doesn't end as running text does."""
        if len(s) > self.short or s[0].islower() or s[-1] in ",;:" or s[-1] in HYPHENS or len(s) > 2 and not _open_end(s):
            return False
        if not self.width or i + 1 >= n:
            return True
        if _side_number(s):
            return True
        j = i + 1
        while j < n and self.kind[j] != "text":
            j += 1
        after = self.line[j].split(None, 1)[0] if j < n else ""
        return len(s) + 1 + len(after) <= self.width or i and not self.line[i - 1] and j > i + 1

    def beside(self, i: int, step: int) -> int:
        """The next line of running text in a direction, or -1."""
        i += step
        while 0 <= i < len(self.line) and self.kind[i] in ("blank", "page", "short", "header"):
            i += step
        return i if 0 <= i < len(self.line) and self.kind[i] == "text" else -1

    def interrupts(self, i: int) -> bool:
        """Running text goes on behind the line as if it weren't there."""
        a, b = self.beside(i, -1), self.beside(i, 1)
        if a < 0 or b < 0:
            return False
        before, after = self.line[a], self.line[b]
        return before[-1] in HYPHENS or _open_end(before) and after[0].islower()

    def at_page(self, i: int) -> bool:
        """A page number stands right above or below."""
        return i > 0 and self.kind[i - 1] == "page" or i + 1 < len(self.kind) and self.kind[i + 1] == "page"


def _core(token: str) -> str:
    return token.strip(_OUTER)


def count(texts: Iterator[str], flush: int = FLUSH) -> Iterator[tuple[str, str, int, int]]:
    """(kind, key, n, m): w words with their counts; l short lines with how often they stood, and how often
    where a running line would; t the number of words and lines."""
    words: Counter = Counter()
    lines: dict[str, list[int]] = {}
    n_lines = 0
    for text in texts:
        parsed = Lines(text)
        for i, (s, k) in enumerate(zip(parsed.line, parsed.kind)):
            if k in ("text", "item"):
                tokens = s.split()
                if i and tokens and parsed.line[i - 1][-1:] in HYPHENS and parsed.line[i - 1]:
                    tokens = tokens[1:]
                if tokens and tokens[-1][-1] in HYPHENS:
                    tokens = tokens[:-1]
                words.update(tokens)
            elif k == "short":
                got = lines.setdefault(skeleton(s), [0, 0])
                got[0] += 1
                got[1] += _side_number(s) or parsed.interrupts(i) or parsed.at_page(i)
                n_lines += 1
        if len(words) + len(lines) > flush:
            yield from _counted(words, lines, n_lines)
            words, lines, n_lines = Counter(), {}, 0
    yield from _counted(words, lines, n_lines)


def _counted(words: Counter, lines: dict[str, list[int]], n_lines: int) -> Iterator[tuple[str, str, int, int]]:
    cores: Counter = Counter()
    for token, n in words.items():
        cores[_core(token)] += n
    yield "t", "", sum(words.values()), n_lines
    yield from (("w", w, n, 0) for w, n in cores.items() if len(w) > 1 and _LETTER.search(w))
    yield from (("l", s, n, m) for s, (n, m) in lines.items())


def _automaton() -> list[int]:
    """The Levenshtein automaton for distance 2 and words of any length, as one table.

    A state holds the distances of the path read so far, of j signs, to the word's prefixes of j - 2 to
    j + 2 signs, cut off at 3, in two bits each. The input is which of the word's signs around j equal the
    next sign, in five bits. table[state << 5 | input] is the next state, -1 where all distances exceed 2.
    """
    table = []
    for state in range(1 << 10):
        band = [state >> 2 * k & 3 for k in range(5)] + [3]
        for signs in range(1 << 5):
            new: list[int] = []
            for k in range(5):
                d = min(band[k + 1] + 1, band[k] + (not signs >> k & 1), (new[k - 1] if k else 3) + 1, 3)
                new.append(d)
            table.append(-1 if min(new) > 2 else sum(d << 2 * k for k, d in enumerate(new)))
    return table


_TABLE_2 = _automaton()
#: Nothing read: the distance to the prefixes of 0, 1, 2 signs is 0, 1, 2; there are none of -2 and -1.
_START = 3 | 3 << 2 | 0 << 4 | 1 << 6 | 2 << 8


class Trie:
    """Vocabulary as nested tables; a word's end holds it under the empty string. It is one part of the vocabulary, of a bounded size."""

    def __init__(self, words):
        self.root: dict = {}
        self.folded: dict[str, list[str]] = {}  # for words with several confusions, which no small distance reaches
        for w in words:
            self.folded.setdefault(fold(w), []).append(w)
            if not _LETTER.match(w):
                continue
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str) -> list[str]:
        """Every word at a Levenshtein distance of 2 or less: the automaton of `word` and the trie run side by side."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 4 << i
        out: list[str] = []
        n, table = len(word) + 2, _TABLE_2
        stack = [(self.root, _START, 0)]
        while stack:
            node, state, j = stack.pop()
            for c, child in node.items():
                if c:
                    new = table[state << 5 | (places.get(c, 0) >> j & 31)]
                    if new >= 0:
                        stack.append((child, new, j + 1))
                elif 0 <= n - j <= 4 and (state >> 2 * (n - j) & 3) <= 2:
                    out.append(child)
        return out


_BY_RIGHT: dict[str, list[tuple[str, str]]] = {}
for _right, _wrong in CONFUSIONS:
    _BY_RIGHT.setdefault(_right[0], []).append((_right, _wrong))


def confused(right: str, wrong: str, most: int = 2) -> int | None:
    """Number of confusions that turn `right` into `wrong`; None if other changes or more than `most` are needed."""
    seen: set[tuple[int, int, int]] = set()
    stack = [(0, 0, 0)]
    best = None
    while stack:
        i, j, k = stack.pop()
        while i < len(right) and j < len(wrong) and right[i] == wrong[j]:
            for a, b in _BY_RIGHT.get(right[i], ()):
                if k < most and right.startswith(a, i) and wrong.startswith(b, j) and (i + len(a), j + len(b), k + 1) not in seen:
                    seen.add((i + len(a), j + len(b), k + 1))
                    stack.append((i + len(a), j + len(b), k + 1))
            i, j = i + 1, j + 1
        if i == len(right) and j == len(wrong):
            best = k if best is None else min(best, k)
        elif k < most and i < len(right):
            for a, b in _BY_RIGHT.get(right[i], ()):
                if right.startswith(a, i) and wrong.startswith(b, j) and (i + len(a), j + len(b), k + 1) not in seen:
                    seen.add((i + len(a), j + len(b), k + 1))
                    stack.append((i + len(a), j + len(b), k + 1))
    return best


def forms(word: str) -> list[str]:
    """A word as it stands and as it may stand elsewhere: a capital may be there for the place, or be misread itself."""
    out = [word]
    if word[0].isupper():
        out.append(word[0].lower() + word[1:])
    if word.isupper() or sum(c.isupper() for c in word) >= 2:
        out += [word.capitalize(), word.lower()]
    return list(dict.fromkeys(out))


def counted_as(word: str) -> list[str]:
    """The words whose counts speak for a word."""
    return list(dict.fromkeys([word, *([word.lower()] if word[:1].isupper() else []), *([word.capitalize()] if word.isupper() else [])]))


def _odd(word: str) -> bool:
    """It holds signs that are no letters."""
    return sum(c.isalpha() for c in word) < len(word.replace("-", "").replace("’", "").replace("'", ""))


def may_be_misread(word: str) -> bool:
    """A word by its form: of letters and of signs that scanners put for them. (Signs that combine with letters, as in
    Devanagari or Thai, are none of these.)"""
    if len(word) < 2 or not _LETTER.search(word) or any(not _WORD_LIKE.match(c) and c != "’" for c in word):
        return False
    letters = sum(c.isalpha() for c in word)
    return not (_odd(word) and (word[0].isupper() and word[1:].isdigit() or 2 * letters < len(word) and len(word) > 2))


def looked_up(word: str, own: int, trie: Trie, counts: dict[str, int], most: int, ratio: int = RATIO) -> list[tuple[str, int, int]]:
    """(candidate, -confusions, count) of the vocabulary words that a word, which stands `own` times, may be a misreading of.

    A candidate is much more common; most: the count of the most common word. Confusions 9: only a misread first letter
    of a sentence explains it.
    """
    least = max(LEAST, (2 if _odd(word) else ratio) * own)
    if least > most:
        return []
    found: dict[str, tuple[int, int]] = {}
    for form in forms(word):
        for c in {*trie.within(form), *trie.folded.get(fold(form), ())}:
            if counts[c] >= least and c != form and (k := confused(c, form, 3)):
                found[c] = max(found.get(c, (-8, 0)), (-k, counts[c]))
    if not word[0].isupper():
        for right, wrong in CONFUSIONS:
            rest = right.lower() + word[len(wrong) :]
            if right.isupper() and word.startswith(wrong) and counts.get(rest, 0) >= least:
                found.setdefault(right + word[len(wrong) :], (-9, counts[rest]))
    return [(c, k, n) for c, (k, n) in found.items()]


class Repairer:
    """What is known for a group of texts. words: counts; verdicts: of misread words the candidates, likeliest first,
    each with what it may itself be a misreading of (or None); headers: skeletons of running lines."""

    def __init__(self, words: dict[str, int], verdicts: dict[str, list[tuple[str, str | None]]], headers: set[str]):
        self.words, self.verdicts, self.headers = words, verdicts, headers
        self._tokens: dict[str, bool] = {}

    def candidates(self, word: str) -> list[str]:
        """What the word may be a misreading of, likeliest first; empty if it is sound or nothing is known."""
        return [c for c, _ in self.verdicts.get(word, ())]

    def _count(self, word: str) -> int:
        return max(self.words.get(w, 0) for w in counted_as(word))

    def parts(self, token: str) -> list[str]:
        core = _core(token)
        if core in self.words and not self.candidates(core) or "-" not in core.strip("-"):
            return [core]
        return [p for p in core.split("-") if p]

    def misread(self, token: str) -> bool:
        got = self._tokens.get(token)
        if got is None:
            got = self._tokens[token] = any(self.candidates(p) for p in self.parts(token))
        return got

    def best(self, word: str, near: set[str]) -> str:
        """The likeliest reading: of the candidates with the fewest confusions one that stands in the text, or else the most common."""
        found = self.candidates(word)
        if not found:
            return word
        here = [c for c in found if c in near and confused(c, word) == confused(found[0], word)]
        best = here[0] if here else found[0]
        best = dict(self.verdicts[word])[best] or best  # a common misreading may itself be in the vocabulary
        return best[0].upper() + best[1:] if word[0].isupper() and not best[0].isupper() else best

    def broken(self, left: str, right: str) -> bool:
        """Do the ends of two lines make one word without a hyphen?"""
        a, b = left.lstrip(_OUTER), right.rstrip(_OUTER)
        if not a or not b or not a[-1].isalpha() and a[-1] not in "0159!@$+|8" or b[0].isupper() and not a.isupper():
            return False
        joined, kept = a + b, f"{a}-{b}"
        whole, apart = self._count(joined), self._count(kept)
        if whole or apart:
            return whole >= apart
        if "-" in b:  # the rest belongs to a compound of which only the first part is broken
            return self.broken(left, b.split("-")[0])
        if "-" in a:
            return self.broken(a.rsplit("-", 1)[1], b)
        if self.candidates(joined):
            return True
        return not (self._count(a) and self._count(b)) and not any(self.candidates(p) for p in (kept,))

    def is_header(self, p: Lines, i: int) -> bool:
        """A known running line, or one that by its place and form can be nothing else."""
        s = p.line[i]
        if skeleton(s) in self.headers or skeleton(s, _FOLD_PAIRS_2) in self.headers:
            return True
        return bool(p.width) and len(s) <= 0.7 * p.width and s.count(" ") < 7 and not re.search(r"[.!?,;:«“]", s) and p.interrupts(i)

    def label(self, text: str) -> tuple[Lines, list[set[str]], dict[int, tuple[int, str]]]:
        """The lines, the kinds of damage of each, and where a broken word goes on: {line: (next line, joined word)}."""
        p = Lines(text)
        kinds: list[set[str]] = [set() for _ in p.line]
        for i, k in enumerate(p.kind):
            if k == "page":
                kinds[i].add("page_no")
            elif k == "short" and self.is_header(p, i):
                p.kind[i] = "header"
                kinds[i].add("header")
        joins: dict[int, tuple[int, str]] = {}
        taken: set[int] = set()
        for i, k in enumerate(p.kind):
            if k not in ("text", "short", "item"):
                continue
            tokens = p.line[i].split()
            if tokens[-1][-1] in HYPHENS and len(tokens[-1]) > 1:
                j = p.beside(i, 1)
                if j >= 0:
                    left, right = tokens[-1][:-1], p.line[j].split(None, 1)[0]
                    if tokens[-1][-1] in "\xad¬" or self.broken(left, right):
                        kinds[i].add("hyphen")
                        joins[i] = (j, left + right)
                        taken.add(j)
                        for word in self.parts(left + right):
                            for c in self.candidates(word)[:1]:
                                at = next((x for x, (u, v) in enumerate(zip(c.lower(), word.lower())) if u != v), len(word) - 1) + (left + right).find(word)
                                kinds[i if at < len(left) else j].add("misread")
                        tokens = tokens[:-1]
                    elif tokens[-1][-1] in HYPHENS:
                        tokens[-1] = tokens[-1][:-1]
            if i in taken:
                tokens = tokens[1:]
            if k != "short" or not p.width:
                if any(self.misread(t) for t in tokens):
                    kinds[i].add("misread")
            elif any(self.misread(t) for t in tokens):
                kinds[i].add("misread")
        return p, kinds, joins

    def repair(self, text: str) -> str:
        """Paragraphs without page furniture, broken words and misreadings; a blank line between them."""
        p, kinds, joins = self.label(text)
        near = set(text.split())
        out: list[str] = []
        body = ""
        pending = ""  # the first part of a broken word
        skip: dict[int, str] = {j: w for _, (j, w) in joins.items()}

        def fixed(token: str) -> str:
            if not self.misread(token):
                return token
            for part in self.parts(token):
                better = self.best(part, near)
                if better != part:
                    token = token.replace(part, better, 1)
            return token

        gap = False
        for i, (s, k) in enumerate(zip(p.line, p.kind)):
            if k in ("page", "header"):
                continue
            if k == "blank":
                gap = True
                continue
            alone = k in ("item", "table", "short")
            if body and not pending and (alone or gap and not (_open_end(body) and s[0].islower())):
                out.append(body)
                body = ""
            gap = False
            tokens = s.split()
            if i in skip:
                tokens[0] = skip[i]
            pending = ""
            if i in joins:
                tokens = tokens[:-1]
                pending = joins[i][1]
            elif tokens and tokens[-1][-1] in HYPHENS and p.beside(i, 1) >= 0 and len(tokens[-1]) > 1 and k == "text":
                pending = tokens[-1][:-1] + "-"
                tokens = tokens[:-1]
            line = " ".join(fixed(t) for t in tokens) if k != "table" else s
            if body.endswith("-") and _compound(body):
                body += line
            else:
                body = f"{body} {line}".strip() if body else line
            if pending.endswith("-"):
                body = f"{body} {fixed(pending[:-1])}-".strip()
                pending = ""
            if k in ("item", "table", "short"):
                out.append(body)
                body = ""
        if body:
            out.append(body)
        return "\n\n".join(out)


def _compound(body: str) -> bool:
    return len(body) > 1 and body[-2].isalpha()


class Asked:
    """What labelling a group of texts may ask: tokens, the two parts of words broken across lines, and skeletons of lines."""

    def __init__(self):
        self.tokens: set[str] = set()
        self.broken: set[tuple[str, str]] = set()
        self.lines: set[str] = set()

    def add(self, text: str) -> None:
        p = Lines(text)
        for i, (s, k) in enumerate(zip(p.line, p.kind)):
            if k == "short":
                self.lines.add(s)
            if k not in ("text", "short", "item"):
                continue
            found = s.split()
            self.tokens.update(found)
            last = found[-1]
            if last[-1] in HYPHENS and len(last) > 1:
                self.tokens.add(last[:-1])
                j = p.beside(i, 1)
                if j >= 0:
                    self.broken.add((last[:-1], p.line[j].split(None, 1)[0]))

    def keys(self) -> tuple[list[str], list[str], list[str]]:
        """Words to judge, words of which the count is asked, and skeletons of lines."""
        judge: set[str] = set()
        counts: set[str] = set()
        todo = list(self.broken)
        while todo:
            left, right = todo.pop()
            a, b = left.lstrip(_OUTER), right.rstrip(_OUTER)
            if a and b:
                judge.update((a + b, f"{a}-{b}"))
                counts.update((a, b))
                todo += [(left, b.split("-")[0])] if "-" in b else []
                todo += [(a.rsplit("-", 1)[1], b)] if "-" in a else []
        for token in self.tokens | {a + b for a, b in self.broken}:
            core = _core(token)
            judge.add(core)
            if "-" in core.strip("-"):
                judge.update(core.split("-"))
        judge.discard("")
        lines = {skeleton(s, pairs) for s in self.lines for pairs in (_FOLD_PAIRS, _FOLD_PAIRS_2)}
        return [w for w in judge if may_be_misread(w)], list({f for w in judge | counts for f in counted_as(w)}), list(lines)


def _batches(rows: Iterator[tuple], schema: str, size: int = 20_000):
    """Record batches of rows, in the types of a schema of names and types."""
    import pyarrow as pa

    text = pa.list_(pa.string())
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": text, "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)], names=[n for n, _ in fields])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _texts(batches) -> Iterator[tuple[int, str]]:
    for b in batches:
        yield from ((i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t)


def statistics(chunks: DataFrame) -> DataFrame:
    """kind (w or l), key, n: words that stand LEAST times, and the skeletons of running lines, over all texts.

    Counts are combined in each task, then by key. A line must stand twice as a running line and at LINE_RATE;
    neither cut depends on the size of the table.
    """
    schema = "kind string, key string, n long, m long"
    rows = chunks.mapInArrow(lambda batches: _batches(count(t for _, t in _texts(batches)), schema), schema)
    counted = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    kept = counted.filter((F.col("kind") == "w") & (F.col("n") >= LEAST) | (F.col("kind") == "l") & (F.col("m") >= 2) & (F.col("m") >= LINE_RATE * F.col("n")))
    return written(kept.select("kind", "key", "n"), "counts")


def groups(chunks: DataFrame) -> DataFrame:
    """grp, ids, texts, judge, counts, lines: texts in groups of about GROUP characters, with what each group asks."""
    schema = "grp long, ids array<long>, texts array<string>, judge array<string>, counts array<string>, lines array<string>"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        def rows():
            n, held, size, asked = 0, [], 0, Asked()
            for chunk, text in _texts(batches):
                held.append((chunk, text))
                size += len(text)
                asked.add(text)
                if size >= GROUP:
                    yield part + n, *zip(*held), *asked.keys()
                    n, held, size, asked = n + 1, [], 0, Asked()
            if held:
                yield part + n, *zip(*held), *asked.keys()

        yield from _batches(rows(), schema, 4)

    return written(chunks.mapInArrow(run, schema), "groups")


def verdicts(words: DataFrame, vocabulary: DataFrame, trie: int | None = None, lookups: int | None = None) -> DataFrame:
    """word, found (array of candidates, likeliest first) of the words (word) that are likely misread.

    vocabulary: key, n. It is cut into parts of about `trie` words by their hash; words into slices of about `lookups`.
    Every slice meets every part, so retrieval is complete, and no task holds more than one part and one slice.
    """
    schema = "word string, form string"
    each = words.mapInArrow(lambda batches: _batches(((w, f) for b in batches for w in b.column(0).to_pylist() for f in counted_as(w)), schema), schema)
    known = vocabulary.select(F.col("key").alias("form"), "n")
    own = each.join(known, "form", "left").groupBy("word").agg(F.coalesce(F.max("n"), F.lit(0)).alias("own"))
    sizes = vocabulary.agg(F.count(F.lit(1)).alias("n")).crossJoin(words.agg(F.count(F.lit(1)).alias("m"))).first()
    parts, slices = 1 + sizes.n // (trie or TRIE), 1 + sizes.m // (lookups or LOOKUPS)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = own.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), hashed("word", slices).alias("slice"), "word", "own")
    right = vocabulary.select(hashed("key", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "key", "n")

    def run(asked, part):
        import pyarrow as pa

        counts = dict(zip(part["key"].to_pylist(), part["n"].to_pylist()))
        held, most = Trie(counts), max(counts.values(), default=0)
        rows = [(w, *row) for w, o in zip(asked["word"].to_pylist(), asked["own"].to_pylist()) for row in looked_up(w, o, held, counts, most)]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["word", "cand", "k", "n"])

    tasks = min(2 * parts * slices, 10_000)  # a number given is kept, however small the tables are
    left, right = (d.repartition(tasks, "part", "slice") for d in (left, right))
    rows = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(run, "word string, cand string, k int, n long")
    capital = lambda c: F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1))
    order = F.struct("k", (capital(F.col("cand")) == capital(F.col("word"))).alias("same"), "n", "cand")
    ranked = rows.groupBy("word").agg(F.sort_array(F.collect_set(order), asc=False).alias("all"))  # words within two changes, or of one folded form
    first = F.filter("all", lambda c: (c["k"] > -9) | (F.col("all")[0]["k"] == -9))
    found = written(ranked.select("word", F.transform(first, lambda c: c["cand"]).alias("found")), "verdicts")
    again = found.select(F.col("word").alias("cand"), F.col("found")[0].alias("again"))
    pairs = found.select("word", F.posexplode("found").alias("at", "cand")).join(again, "cand", "left")
    return pairs.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "cand", "again"))).alias("f")).select("word", F.transform("f", lambda c: F.struct(c["cand"].alias("cand"), c["again"].alias("again"))).alias("found"))


def answered(chunks: DataFrame) -> DataFrame:
    """grp, ids, texts, known (array of word, n, found), headers: groups of texts with the answers to what they ask."""
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").filter("text is not null")
    counts = statistics(rows)
    packed = groups(rows)
    vocabulary = counts.filter("kind = 'w'").select("key", "n")
    judge = packed.select("grp", F.explode("judge").alias("word"))
    found = verdicts(judge.select("word").distinct(), vocabulary)
    numbers = packed.select("grp", F.explode("counts").alias("word")).join(vocabulary.withColumnRenamed("key", "word"), "word")
    misread = judge.join(found, "word")
    both = numbers.withColumn("found", F.lit(None).cast(found.schema["found"].dataType)).unionByName(misread.withColumn("n", F.lit(None).cast("long")))
    # what a group asks is bounded by its texts
    known = both.groupBy("grp").agg(F.collect_list(F.struct("word", "n", "found")).alias("known"))
    lines = packed.select("grp", F.explode("lines").alias("key")).join(counts.filter("kind = 'l'").select("key"), "key")
    headers = lines.groupBy("grp").agg(F.collect_list("key").alias("headers"))
    return packed.select("grp", "ids", "texts").join(known, "grp", "left").join(headers, "grp", "left")


def _mapped(chunks: DataFrame, each, schema: str) -> DataFrame:
    """Rows that `each` makes of (repairer, chunk_id, text), with the statistics of all texts."""

    def run(batches):
        def rows():
            for b in batches:
                for k in range(b.num_rows):
                    _, ids, texts, known, headers = (c[k].as_py() for c in b.columns)
                    words = {x["word"]: x["n"] for x in known or () if x["n"] is not None}
                    misread = {x["word"]: [(f["cand"], f["again"]) for f in x["found"]] for x in known or () if x["found"]}
                    repairer = Repairer(words, misread, set(headers or ()))
                    for chunk, text in zip(ids, texts):
                        yield from each(repairer, chunk, text)

        yield from _batches(rows(), schema)

    return answered(chunks).select("grp", "ids", "texts", "known", "headers").mapInArrow(run, schema)


def damaged_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind) of every damaged line: hyphen, header, page_no, misread. Copies count once.

    Lines are parted by U+000A and counted from 1. Null and empty texts have none.
    """

    def each(repairer: Repairer, chunk: int, text: str):
        _, kinds, _ = repairer.label(text)
        return [(chunk, i + 1, k) for i, ks in enumerate(kinds) for k in ks]

    return _mapped(chunks, each, "chunk_id long, line_no int, kind string").distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text) with every text repaired to paragraphs; copies of a chunk stay as they are many."""
    return _mapped(chunks, lambda repairer, chunk, text: [(chunk, repairer.repair(text))], "chunk_id long, text string")
