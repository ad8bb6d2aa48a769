import os
import random

import pytest

from shelfspark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
TEXTS = ["", "Hello  world", " <|endoftext|> is plain", "don't WE'LL\n\n\n x\t\ty   z ", "第20号文件（见图14）説明", "ना्हिन्दी ไทย بار", "½ Ⅷ ② a²b", "👩‍🔧🏳️‍🌈 é", "x" * 3000, "\x1c\x1d a b c", "a \n b", "  lead", "trail  ", "\r\n\r\n q"]


@pytest.fixture(scope="module")
def tools():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(bpe.MergeAutomaton(ranks)), other


def test_equal_to_the_library_and_round_trip(tools):
    encoder, other = tools
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdeth inger  \n\t'.,²½é日本語ना्ไทย0123-_ 　") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == other.encode_ordinary(t)
        assert encoder.automaton.decode(ids) == t


def test_tables(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(90, None, None), (91, "same", ""), (91, "same", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.ids for r in got}[90] == [] and {r.doc_id: r.ids for r in got}[0] == []
    assert bpe.encode_documents(df.limit(0)).count() == 0
