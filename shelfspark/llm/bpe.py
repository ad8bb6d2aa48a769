"""Encoding a corpus with a byte-level BPE vocabulary through a tokenization automaton.

Start from an automaton with one state that reads any sequence of bytes. Every merge (u, v) -> uv, in
order of rank, adds a gadget: an arc uv beside the path u v, while the path u v itself is closed. After
all merges the automaton is deterministic over tokens, its states are the tokens last read, and it
accepts exactly the correct tokenizations. With 50,000 merges the full table has 2.5 billion arcs, of
which texts touch some hundred thousand, so whether arc (a, b) is still open after all gadgets is
worked out when it is first asked for and then stands in the table of transitions (`MergeAutomaton.table`).

Encoding a pre-split word runs left to right: at each byte exactly one token ends that has an open arc
from the state reached at its start. Decoding emits the labels of the arcs, the tokens' bytes.
"""

from __future__ import annotations

import base64
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The pre-split pattern published with the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and arcs kept by a worker; beyond it the table is emptied and fills again.
KEPT = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeAutomaton:
    """States are the tokens last read; `table` has a row for each, from a token to whether its arc is open.

    parts: what each merge joins, if that was worked out before (see `compiled`).
    """

    def __init__(self, ranks: dict[bytes, int], parts: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.label = {i: t for t, i in ranks.items()}
        # length of the longest token that ends in these two bytes: no longer arc needs a look
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 1:
                self.reach[token[-2:]] = max(self.reach.get(token[-2:], 1), len(token))
        # the two parts that each merge joins: the split whose parts both come before it, with the later part earliest
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                joined = parts[rank] if parts is not None else self._built_from(token, rank)
                self.parts[rank] = joined
                self.merge.setdefault(joined, rank)
        self.table: dict[int, dict[int, bool]] = {}
        self._arcs = 0

    def _built_from(self, token: bytes, rank: int) -> tuple[int, int]:
        """Merge the token's bytes by the merges before it until two parts are left."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.merge.get((parts[i], parts[i + 1]), rank))
            parts[best : best + 2] = [self.merge[parts[best], parts[best + 1]]]
        return parts[0], parts[1]

    def open(self, a: int, b: int) -> bool:
        """Is the path a b open after all merge gadgets?

        A gadget closes it if it merges, across the seam, parts that stand there before a or b are
        complete. Undo the merges of a on its right edge and of b on its left edge, latest first, and
        look for such a gadget.
        """
        row = self.table.get(a)
        if row is None:
            row = self.table[a] = {}
        got = row.get(b)
        if got is None:
            if self._arcs >= KEPT:
                self.table.clear()
                row, self._arcs = self.table.setdefault(a, {}), 0
            self._arcs += 1
            got = row[b] = self._survives(a, b)
        return got

    def _survives(self, a: int, b: int) -> bool:
        built_a = built_b = 1 << 60  # the merge that consumes what is now at the seam, on either side
        while True:
            seam = self.merge.get((a, b))
            # it fires before a's part is consumed; against the merge on its right it also wins a tie, being further left
            if seam is not None and seam < built_a and seam <= built_b:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a >= b:
                built_a, a = a, left[1]
            else:
                built_b, b = b, right[0]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ranks, reach = self.ranks, self.reach
        state: list[int] = [-1]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - reach.get(word[max(0, end - 2) : end], 1)), end):
                t = ranks.get(word[start:end])
                if t is not None and (start == 0 or self.open(state[start], t)):
                    state.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        out, at = [], len(word)
        while at:
            out.append(state[at])
            at -= len(self.label[state[at]])
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", errors="replace")


def _odd_signs() -> frozenset[str]:
    """Signs that the standard library's patterns class otherwise than the published one: numbers but digits, and four controls."""
    import sys
    import unicodedata

    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")) | frozenset("\x1c\x1d\x1e\x1f")


class Encoder:
    """Encodes texts to ids in native 32-bit integers, as bytes; words that were met before come from a table.

    odd: the result of `_odd_signs`, if it was worked out before.
    """

    def __init__(self, automaton: MergeAutomaton, odd: frozenset[str] | None = None):
        import regex

        self.automaton = automaton
        self._exact = regex.compile(PATTERN)
        # the same pattern for the standard library's faster engine, for texts without the few signs it classes otherwise
        self._plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self._odd = odd or _odd_signs()
        # a run of three or more blanks may form one word across a space
        self._run = re.compile(r"\s{3}")
        self._words = _Table(lambda w: array("i", automaton.encode(w.encode("utf-8", "surrogatepass"))).tobytes())
        self._pieces = _Table(lambda p: self._split(" " + p))

    def _split(self, text: str) -> bytes:
        pattern = self._plain if self._odd.isdisjoint(text) else self._exact
        return b"".join(map(self._words.__getitem__, pattern.findall(text)))

    def packed(self, text: str) -> bytes:
        """A space always begins a word, unless it stands in a longer run of blanks: so the text falls
        into pieces at its spaces, each encoded on its own."""
        if not text:
            return b""
        if self._run.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self._pieces.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


class _Table(dict):
    """Results by argument, emptied when it holds KEPT of them."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        out = self._make(key)
        if len(key) <= 200:
            self[key] = out
        return out


_ENCODERS: dict[str, Encoder] = {}


def compiled(vocabulary: str) -> tuple[dict[bytes, int], dict[int, tuple[int, int]], frozenset[str]]:
    """What every worker's automaton is built from: ranks, the parts of each merge, and the odd signs."""
    ranks = read_ranks(vocabulary)
    return ranks, MergeAutomaton(ranks).parts, _odd_signs()


def encode_documents(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row's whole text, without special tokens.

    Strings that look like special tokens are plain text; an empty or null text gives an empty list; a
    row stands as often as it does in the input. Extra columns are not read. The vocabulary (a fixed
    file of some 50,000 entries) and its merges go to the workers once; there is no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(compiled(vocabulary))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = _ENCODERS.get(vocabulary)
        if encoder is None:
            ranks, parts, odd = shared.value
            encoder = _ENCODERS[vocabulary] = Encoder(MergeAutomaton(ranks, parts), odd)
        for batch in batches:
            packed = [encoder.packed(text) if text else b"" for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)
