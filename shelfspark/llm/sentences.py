"""Sentence units across languages and scripts: candidate boundaries, classified by maximum entropy.

Lines are first told apart: blank lines, list items and headings end a unit by themselves; the rest is
running text. In running text every run of sentence marks is a candidate. A maximum-entropy model decides,
from the tokens beside it, their case, length, digits and script, the mark, its closing quotes, and whether
the unit began with a quotation.

It is trained without hand-made labels on boundaries that are certain: where a mark ends a paragraph, a
sentence ends (and the next one begins with the next paragraph's first token). All other candidates are
unlabelled, so the model learns the chance that a candidate is a *certain* boundary; divided by its mean
over certain boundaries, that is the chance of being a boundary (learning from positive and unlabelled
examples). An abbreviation never ends a paragraph, so its chance is near zero wherever it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.util import bounded_sample

#: Documents the model is trained on and characters of one at most, rounds of training, penalty, and the least chance of a boundary.
SAMPLE, LONGEST, ROUNDS, PENALTY, LEAST = 10_000, 20_000, 300, 0.3, 0.12

#: Kinds of examples taken of an abbreviation that no document of the sample has.
PER_TOKEN = 32

#: Decisions kept by a worker; beyond it the table is emptied and fills again.
KEPT = 500_000

_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_BLANK = "​﻿"
_ITEM = re.compile(r"(?:[-*•‣▪◦·–—]|\(?\d{1,3}[.)]|[①-⑳])[\s​]+(?=\S)")
_MARKDOWN = re.compile(r"#{1,6}\s")
_TERMINAL = re.compile(r"[.!?…。！？।؟۔]['\"”’“»」』）)\]\s]*$")
_CANDIDATE = re.compile(r"(?:[.!?…]+(?:['\"”’“)\]]|[ \xa0\u202f]?»)*|[。！？।؟۔…]+['\"”’」』）)\]»]*)")
_THAI = re.compile(r"(?<=[ก-๛])[\s​]+(?=[ก-๛])")
_OPENERS = "\"“„«「『‘'‹"
_OPEN_STRIP = "\"'“„«「『‘‹(（[¿¡"
_DIGIT = re.compile(r"\d")


def _inner(text: str, a: int, b: int) -> tuple[int, int]:
    """a..b without outer blanks."""
    while a < b and (text[a].isspace() or text[a] in _BLANK):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in _BLANK):
        b -= 1
    return a, b


def blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines (start, end, without outer blanks) between blank lines."""
    block: list[tuple[int, int]] = []
    last = 0
    for m in _LINE.finditer(text):
        if block and m.start() - last > 1 and text[last : m.start()] != "\r\n":
            yield block
            block = []
        a, b = _inner(text, *m.span())
        last = m.end()
        if a < b:
            block.append((a, b))
        elif block:
            yield block
            block = []
    if block:
        yield block


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): kind is item, heading or text (running text that may hold several sentences)."""
    found = list(blocks(text))
    wrap = -1  # found when it is asked for
    for block in found:
        if len(block) == 1:
            a, b = block[0]
            yield _alone(text, a, b), a, b
            continue
        begun, ended = -1, True  # start of running text; whether the line before ended something
        for i, (a, b) in enumerate(block):
            item = _ITEM.match(text, a, b)
            if item and not ended and text[a].isdigit():
                item = None  # a number at the start of a wrapped line
            head = not item and ended and i + 1 < len(block) and _may_head(text, a, b, block[i + 1][0])
            if head:
                if wrap < 0:
                    wrap = _wrap(found)
                head = _broken_off(text, block, i, wrap)
            if item or head or _MARKDOWN.match(text, a, b):
                if begun >= 0:
                    yield "text", begun, block[i - 1][1]
                    begun = -1
                yield "item" if item else "heading", a, b
                ended = True
            else:
                if begun < 0:
                    begun = a
                ended = bool(_TERMINAL.search(text, max(a, b - 8), b)) or "ก" <= text[b - 1] <= "๛"
        if begun >= 0:
            yield "text", begun, block[-1][1]


def _alone(text: str, a: int, b: int) -> str:
    if _ITEM.match(text, a, b):
        return "item" if _TERMINAL.search(text, max(a, b - 8), b) else "heading"
    if _MARKDOWN.match(text, a, b) or not _TERMINAL.search(text, max(a, b - 8), b) and not _THAI.search(text, a, b) and not _CANDIDATE.search(text, a + 6, b):
        return "heading"
    return "text"


def _may_head(text: str, a: int, b: int, after: int) -> bool:
    """A line without a sentence mark (but for a number's) whose next line doesn't go on in lower case."""
    if text[after].islower() or text[b - 1] in ",;:，、；：،؛-" or _TERMINAL.search(text, max(a, b - 8), b):
        return False
    return not _THAI.search(text, a, b) and not _CANDIDATE.search(text, a + 6, b)


#: A line of this share of the widest of its block is full; one of less than the other share is short.
FULL, SHORT = 0.75, 0.6


def _wrap(found: list[list[tuple[int, int]]]) -> int:
    """The width to which the text's paragraphs are wrapped; 0 if none is: one has two full lines beside its last."""
    out = 0
    for block in found:
        if len(block) > 2:
            lengths = [b - a for a, b in block]
            widest = max(lengths)
            if widest > out and sum(n >= FULL * widest for n in lengths[:-1]) > 1:
                out = widest
    return out


def _broken_off(text: str, block: list[tuple[int, int]], i: int, wrap: int) -> bool:
    """The line ends although the next line's first word would have fitted: it stands by itself, whatever its length.

    A short line of its block does; so does the widest of a block that isn't wrapped, unless the text's wrapped
    paragraphs are so wide, or it breaks off behind a small word or before a number.
    """
    a, b = block[i]
    after, end = block[i + 1]
    word = 1 if ord(text[after]) > 0x2E80 else len(text[after:end].split(None, 1)[0])
    lengths = [y - x for x, y in block]
    widest, need = max(lengths), b - a + 1 + word
    if need <= SHORT * widest:
        return True
    if any(n >= FULL * widest for k, n in enumerate(lengths[:-1]) if k != i):
        return False
    last = text[a:b].rsplit(None, 1)[-1]
    return not wrap and not text[after].isdigit() and not (len(last) < 4 and last.islower()) or need <= FULL * wrap


def _shape(token: str) -> str:
    if not token:
        return "none"
    c = token[0]
    if c.isdigit():
        return f"digit{min(len(token), 5)}"
    if c.isupper():
        return "initial" if len(token) == 1 else "upper" if token.isupper() else "capital"
    if c.islower():
        return f"lower{min(len(token), 4)}"
    if c in _OPENERS:
        return "quote"
    if c.isalpha():
        o = ord(c)
        return f"script{o >> 8 if o < 0x3000 else 'cjk'}"
    return f"sign{c}"


def features(text: str, start: int, first: int, a: int, b: int, end: int, dotted: set[str]) -> tuple[str, ...]:
    """Of the candidate text[a:b] in a sentence from `start` of running text first..end."""
    left = text[max(first, a - 24) : a].rsplit(None, 1)
    left = left[-1].lstrip(_OPEN_STRIP) if left else ""
    right = text[b : min(end, b + 28)].split(None, 1)
    return _features(left, text[a:b], right[0] if right else "", text[start] in _OPENERS, dotted)


def _token(word: str) -> str:
    return _DIGIT.sub("0", word.lstrip(_OPEN_STRIP).lower())[-16:]


def _features(left: str, mark: str, right: str, quoted: bool, dotted: set[str]) -> tuple[str, ...]:
    """dotted: tokens that hardly ever stand without a full stop; only these count by themselves on the left."""
    if left and ord(left[-1]) > 0x2E80:
        left = left[-1:]
    if right and ord(right[0]) > 0x2E80:
        right = right[0] if "ぁ" <= right[0] <= "ゟ" else "々"
    ls, rs = _shape(left), _shape(right)
    low = _token(left)
    if mark[0] != "." or low not in dotted:
        low = "single" if len(low) == 1 and mark[0] == "." else "*"
    mark = mark.replace(" ", "").replace("\xa0", "").replace(" ", "")
    closing = len(mark.rstrip("'\"”’“»」』）)]")) < len(mark)
    bare = right.lstrip(_OPEN_STRIP).rstrip(".,;:!?")
    m = mark if len(mark) < 4 else mark[:3]
    return (
        f"l={low}",
        f"r={_DIGIT.sub('0', bare)[:16]}",
        f"m={m}",
        f"ls={ls}",
        f"rs={rs}",
        f"ls,rs={ls},{rs}",
        f"m,rs={m},{rs}",
        f"m,ls={m},{ls}",
        f"q={int(quoted)},{int(closing)},{m[0]}",
        f"q,rs={int(quoted)},{int(closing)},{rs}",
    )


class Model:
    """Weights by feature. `is_end` gives the decision for a tuple of features."""

    def __init__(self, weights: dict[str, float], bias: float, cut: float, dotted: set[str]):
        self.weights, self.bias, self.cut, self.dotted = weights, bias, cut, dotted

    def score(self, feats: tuple[str, ...]) -> float:
        w = self.weights
        return self.bias + sum([w.get(f, 0.0) for f in feats])

    def is_end(self, feats: tuple[str, ...]) -> bool:
        return self.score(feats) > self.cut


def stops(texts: Iterable[str]) -> dict[str, list[int]]:
    """How often each token stands, and how often of that with a full stop: [with, all]."""
    counted: Counter = Counter()
    for text in texts:
        counted.update(text.split())
    out: dict[str, list[int]] = {}
    for word, n in counted.items():
        token, stopped = _stopped(word)
        one = out.setdefault(token, [0, 0])
        one[0] += n if stopped else 0
        one[1] += n
    return out


def _stopped(word: str) -> tuple[str, bool]:
    """The token of a word as it stands in the text, and whether it ends in a full stop."""
    bare = word.rstrip(",;:!?\"”’“»)]…")
    return _token(bare.rstrip(".")), bare[-1:] == "."


def dotted_tokens(texts: Iterable[str], share: float = 0.9) -> set[str]:
    """Tokens of which at least `share` of the occurrences end in a full stop."""
    return {t for t, (n, total) in stops(texts).items() if n >= share * total and n > 1}


def all_dotted_tokens(documents: DataFrame, share: float = 0.9) -> set[str]:
    """`dotted_tokens` of all documents: counted in each task, then by token.

    What comes to the driver are the tokens that hardly ever stand without a full stop; their number grows with
    the vocabulary, not with the rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counted = stops(t for t in batch.column(0).to_pylist() if t)
            columns = [pa.array(list(counted), pa.string()), *(pa.array([c[i] for c in counted.values()], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "n", "total"])

    counted = documents.select("text").mapInArrow(run, "token string, n long, total long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return {r.token for r in counted.filter((F.col("n") > 1) & (F.col("n") >= F.lit(share) * F.col("total"))).select("token").toLocalIterator()}


def examples(texts: list[str], dotted: set[str]) -> Counter:
    """(features, certain) -> count over the candidates in running text."""
    out: Counter = Counter()
    for text in texts:
        paragraphs = [(k, a, b) for k, a, b in units(text) if k != "heading"]
        for n, (kind, a, b) in enumerate(paragraphs):
            if kind == "item":
                continue
            start = a
            following = text[paragraphs[n + 1][1] : paragraphs[n + 1][1] + 28].split(None, 1)[:1] if n + 1 < len(paragraphs) and paragraphs[n + 1][0] == "text" else []
            for m in _CANDIDATE.finditer(text, a, b):
                i, j = m.span()
                if j == b:
                    if following:
                        left = text[max(a, i - 24) : i].rsplit(None, 1)
                        out[_features(left[-1].lstrip(_OPEN_STRIP) if left else "", m.group(), following[0], text[start] in _OPENERS, dotted), True] += 1
                elif _spaced(text, i, j):
                    out[features(text, start, a, i, j, b, dotted), False] += 1
                    # for the next one: where the sentence may have begun
                    k, _ = _inner(text, j, b)
                    if not text[k].islower() and not (text[start] in _OPENERS and j - i > 1):
                        start = k
    return out


def _spaced(text: str, i: int, j: int) -> bool:
    """A candidate is followed by a blank, ends in a mark that needs none, or joins a small and a capital letter."""
    c = text[j]
    if c.isspace() or c in _BLANK or text[i] in "。！？।؟۔":
        return True
    return c.isupper() and i > 2 and text[i - 1].islower() and text[i - 2].islower() and j + 1 < len(text) and not text[j + 1].isupper()


def train(texts: list[str], rounds: int = ROUNDS, penalty: float = PENALTY, least: float = LEAST, dotted: set[str] | None = None, further: Counter | None = None) -> Model:
    """Maximum likelihood with a quadratic penalty, by full gradients with a step size for each weight.

    dotted: the dotted tokens of all texts; those of the texts trained on if not given. further: examples added.
    """
    dotted = dotted_tokens(texts) if dotted is None else dotted
    counted = examples(texts, dotted) + (further or Counter())
    names = {f: i for i, f in enumerate(dict.fromkeys(f for feats, _ in counted for f in feats))}
    if not names:
        return Model({}, 1.0, 0.0, dotted)
    rows: dict[tuple[str, ...], list[int]] = {}
    for (feats, certain), n in counted.items():
        rows.setdefault(feats, [0, 0])[certain] += n
    # single tokens on the right need more evidence
    weigh = penalty * np.array([3.0 if f.startswith("r=") else 1.0 for f in names])
    index = np.array([[names[f] for f in feats] for feats in rows])
    counts = np.array(list(rows.values()), np.float64)
    total, positive = counts.sum(1), counts[:, 1]
    w, b = np.zeros(len(names)), float(np.log((positive.sum() + 1) / (counts[:, 0].sum() + 1)))
    speed, b_speed = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + w[index].sum(1), -30, 30)))
        error = total * p - positive
        g = np.bincount(index.ravel(), np.repeat(error, index.shape[1]), len(names)) + weigh * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
        b_speed += error.sum() ** 2
        b -= 0.5 * error.sum() / np.sqrt(b_speed)
    p = 1 / (1 + np.exp(-np.clip(b + w[index].sum(1), -30, 30)))
    # the median chance over certain boundaries stands for a boundary's chance to be a certain one
    order = np.argsort(p)
    half = np.searchsorted(np.cumsum(positive[order]), positive.sum() / 2)
    usual = float(p[order][min(half, len(p) - 1)]) if positive.sum() else 0.5
    cut = min(0.999, max(1e-6, least * usual))
    return Model({f: float(w[i]) for f, i in names.items()}, b, float(np.log(cut / (1 - cut))), dotted)


class Splitter:
    def __init__(self, model: Model):
        self.model = model
        self._known: dict[tuple, bool] = {}

    def ends(self, text: str) -> list[int]:
        """End of each sentence, in order: code points from the start to its last character inclusive."""
        out: list[int] = []
        known, blank = self._known, _BLANK
        for kind, a, b in units(text):
            if kind == "text":
                start = a
                for m in _CANDIDATE.finditer(text, a, b):
                    i, j = m.span()
                    if j >= b:
                        break
                    if not _spaced(text, i, j):
                        continue
                    left = text[max(a, i - 24) : i].rsplit(None, 1)
                    right = text[j : min(b, j + 28)].split(None, 1)
                    key = (left[-1] if left else "", m.group(), right[0] if right else "", text[start] in _OPENERS)
                    end = known.get(key)
                    if end is None:
                        if len(known) > KEPT:
                            known.clear()
                        end = known[key] = self.model.is_end(_features(key[0].lstrip(_OPEN_STRIP), *key[1:], self.model.dotted))
                    if end:
                        out.append(j)
                        start = j
                        while text[start].isspace() or text[start] in blank:
                            start += 1
                if _THAI.search(text, a, b):
                    out += [m.start() for m in _THAI.finditer(text, a, b)]
                    out = sorted(set(out))
            out.append(b)
        return out


def training_texts(documents: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most `sample` texts of at most LONGEST characters, chosen by a hash of their id: what the model is fitted to."""
    rows = bounded_sample(documents.select("doc_id", "text").filter((F.length("text") > 0) & (F.length("text") <= LONGEST)), "doc_id", sample)
    return [r.text for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def rare_examples(documents: DataFrame, texts: list[str], dotted: set[str], most: int = PER_TOKEN) -> Counter:
    """Examples of the dotted tokens that `texts` has none of: the `most` commonest of each token, over all documents."""
    unseen = {f"l={t}" for t in dotted} - {feats[0] for feats, _ in examples(texts, dotted)}
    if not unseen:
        return Counter()
    shared = documents.sparkSession.sparkContext.broadcast((dotted, unseen))

    def run(batches):
        import pyarrow as pa

        dotted, unseen = shared.value
        wanted: set[str] = set()  # words of unseen tokens, and all others met
        others: set[str] = set()
        for batch in batches:
            texts = []
            for text in batch.column(0).to_pylist():
                words = set((text or "").split())
                for word in words - wanted - others:
                    (wanted if f"l={_stopped(word)[0]}" in unseen else others).add(word)
                if not words.isdisjoint(wanted):
                    texts.append(text)
                if len(others) > KEPT:
                    others.clear()
            counted = examples(texts, dotted)
            rows = [(feats[0], list(feats), certain, n) for (feats, certain), n in counted.items() if feats[0] in unseen]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int64()))], names=["token", "feats", "certain", "n"])

    counted = documents.select("text").mapInArrow(run, "token string, feats array<string>, certain boolean, n long").groupBy("token", "feats", "certain").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("token").orderBy(F.desc("n"), "feats", "certain"))
    kept = counted.withColumn("place", place).filter(F.col("place") <= most)
    return Counter({(tuple(r.feats), r.certain): r.n for r in sorted(kept.collect(), key=lambda r: (r.feats, r.certain))})


def corpus_model(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted to a sample, with the dotted tokens of all documents and examples of each."""
    texts, dotted = training_texts(documents, sample), all_dotted_tokens(documents)
    return train(texts, dotted=dotted, further=rare_examples(documents, texts, dotted))


_SPLITTERS: dict[str, Splitter] = {}


def sentences(documents: DataFrame, with_text: bool = False, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, end_pos) of every sentence of every document; with_text: doc_id, n, start_pos, end_pos, sentence.

    A heading alone on its line is a unit, so is a list item with its marker; Thai is parted at blanks; the
    last unit may lack a mark. Null and blank texts have no rows. Documents that stand twice are read twice.
    The model is fitted to a bounded sample, its list of abbreviations counted over all texts; every text is read whole. There is no shuffle of texts.
    """
    spark = documents.sparkSession
    import uuid

    model = spark.sparkContext.broadcast(corpus_model(documents, sample))
    token = uuid.uuid4().hex
    schema = "doc_id long, n int, start_pos int, end_pos int, sentence string" if with_text else "doc_id long, end_pos int"

    def run(batches):
        import pyarrow as pa

        splitter = _SPLITTERS.get(token)
        if splitter is None:
            _SPLITTERS.clear()
            splitter = _SPLITTERS[token] = Splitter(model.value)
        for batch in batches:
            docs, found, n, starts, parts = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ends = splitter.ends(text)
                docs += [doc] * len(ends)
                found += ends
                if with_text:
                    at = 0
                    for k, e in enumerate(ends):
                        s, _ = _inner(text, at, e)
                        n.append(k + 1)
                        starts.append(s)
                        parts.append(text[s:e])
                        at = e
            ids, ends = pa.array(docs, pa.int64()), pa.array(found, pa.int32())
            if with_text:
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(starts, pa.int32()), ends, pa.array(parts, pa.string())], names=["doc_id", "n", "start_pos", "end_pos", "sentence"])
            else:
                yield pa.RecordBatch.from_arrays([ids, ends], names=["doc_id", "end_pos"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    return rows.mapInArrow(run, schema)
