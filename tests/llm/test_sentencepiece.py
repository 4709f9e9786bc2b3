"""Encoding against the library, a plain Viterbi and round trips."""

import random
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest

from conftest import TESTDATA
from quaestor.llm import queries, sentencepiece_viterbi as sp
from quaestor.llm.queries import MODEL_FILE


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.model_bytes(MODEL_FILE))


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "i4").tolist()


ODD = [
    "", " ", "  ", " a", "a ", "a  b", "a   b    ", "\n", "a\n\nb", "\t", "▁", "▁▁a", "a▁b", "é", "你好", "😀 x",
    "\x00", "x" * 3000, "ab " * 500, "aaaaaaa", "The the THE", "1234567890 " * 20, "​", "Ünïcode ﬁ ①",
]


def test_odd_texts_as_the_library(encoder):
    for text in ODD:
        assert ids(encoder, text) == encoder.v.processor.encode(text), repr(text)


def test_random_texts_as_the_library_and_back(encoder):
    draw = random.Random(5)
    parts = ["the", "ing", " ", "  ", "é", "\n", "▁", "x", "q", "tion", "你", "😀", "THE", ".", "00"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(20)))
        own = ids(encoder, text)
        assert own == encoder.v.processor.encode(text)
        if "▁" not in text:
            assert encoder.decode(own) == text


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(sp, "CACHED_CHARS", 10)
    monkeypatch.setattr(sp, "KNOWN_PAIRS", 3)
    small = sp.Encoder(sp.model_bytes(MODEL_FILE))
    for text in ("one two three", "four five one", "two six"):
        assert ids(small, text) == small.v.processor.encode(text)


def test_scores_give_the_best_path_of_a_unigram_model():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -4.0, "c": -3.0, "bc": -3.1, "▁": -1.0, "▁a": -2.2, "ca": -2.9}
    pieces = list(scores)
    vocabulary = SimpleNamespace(
        merges=False, unknown_score=-15.0, unknown=0, bytes={}, scores=dict(enumerate(scores.values())),
        endings={p[k:]: -1 for p in pieces for k in range(len(p))} | {p: i for i, p in enumerate(pieces)},
        settled=lambda found: found,
    )
    lattice = sp.Lattice(vocabulary)

    def best(word):
        found = -1e9
        for n in range(len(word)):
            for cuts in combinations(range(1, len(word)), n):
                ends = [0, *cuts, len(word)]
                own = [word[a:b] for a, b in zip(ends, ends[1:])]
                if all(p in scores or len(p) == 1 for p in own):
                    found = max(found, sum(scores.get(p, -15.0) for p in own))
        return found

    draw = random.Random(3)
    words = sorted({"▁" + "".join(draw.choice("abcz") for _ in range(draw.randrange(1, 8))) for _ in range(200)})
    for word in words:
        total = sum(vocabulary.scores.get(i, -15.0) for i in lattice.ids(word))
        assert total == pytest.approx(best(word)), word


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b", "x", 7), (1, "a b", "x", 7), (None, None, None, None), (2, "", "y", 1), (3, "z" * 50_000, "", 0)],
        "doc_id long, text string, n_tokens string, token_ids int",
    )
    found = sp.decode_documents(sp.encode_documents(docs, MODEL_FILE), MODEL_FILE).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 5 and found[0].token_ids == found[1].token_ids
    assert by_id[None].token_ids is None and by_id[None].n_tokens is None and by_id[None].decoded is None
    assert by_id[2].token_ids == [] and by_id[2].n_tokens == 0 and by_id[2].decoded == ""
    assert by_id[3].decoded == "z" * 50_000 and by_id[3].n_tokens == len(by_id[3].token_ids)
    assert sp.encode_documents(docs.limit(0), MODEL_FILE).count() == 0


def test_ids_of_no_piece_decode_to_null(spark):
    df = spark.createDataFrame([([10**6],), ([-1],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded for r in sp.decode_documents(df, MODEL_FILE).collect()] == [None, None, None, ""]


def test_ids_and_their_text_from_one_pass(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    both = sp.encode_documents(docs, MODEL_FILE, decoded="again")
    steps = sp.decode_documents(sp.encode_documents(docs, MODEL_FILE), MODEL_FILE, "again")
    assert both.orderBy("doc_id").collect() == steps.orderBy("doc_id").collect()
    plan = queries.op1_sentencepiece(spark, str(TESTDATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
