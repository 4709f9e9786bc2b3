"""MinHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest

import plain
from quaestor.llm import bayes_minhash, pairs
from test_partenum import corpus


def run(spark, docs):
    found = bayes_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def expected(docs):
    return {d: (n, c, c == d) for d, (n, c) in plain.near_duplicates(docs, 85).items()}


def edited(seed, members):
    """One base text with some random edits in each member: similarities on both sides of the threshold."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for _ in range(members):
        own = list(base)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**9)}"
        docs.append(" ".join(own))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_all_pairs(spark, seed):
    docs = corpus(seed, 200, 120)
    found = run(spark, docs)
    assert found == expected(docs)
    assert sum(not kept for _, _, kept in found.values()) > 20


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bayes_minhash, "BLOCK", 16)
    monkeypatch.setattr(pairs, "DEGREE", 8)
    docs = edited(5, 150)
    found = run(spark, docs)
    assert found == expected(docs)
    assert 3 < len({c for _, c, _ in found.values()}) < 140


def pair_of(draw, size, changed):
    both = draw.integers(0, 2**63, size - changed, dtype="u8")
    return [np.unique(np.concatenate([both, draw.integers(0, 2**63, changed, dtype="u8")])) for _ in "ab"]


def test_sets_at_the_threshold_share_a_band_and_survive():
    draw = np.random.default_rng(1)
    for size in [*range(1, 40), 100, 400, 1500, 5000]:
        for _ in range(8):
            a, b = pair_of(draw, size, size * 3 // 37)  # 34 / 40
            assert bayes_minhash.linked(a, b)
            least = bayes_minhash.minima([a, b])
            keys = bayes_minhash.band_keys(least)
            assert (keys[0] == keys[1]).any()
            bits = bayes_minhash.sketches(least)
            assert bayes_minhash.survive(bits[:1], bits[1:]).all()


def test_minima_agree_as_often_as_sets_are_similar():
    draw = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        a, b = pair_of(draw, 370, 30)  # 340 / 400
        least = bayes_minhash.minima([a, b])
        shares.append((least[0] == least[1]).mean())
    assert np.mean(shares) == pytest.approx(0.85, abs=0.01)
    assert np.std(shares) < 0.035  # 0.0225 for independent functions


def test_unlikely_pairs_are_given_up_in_the_first_batches():
    need = bayes_minhash.least_matches()
    assert list(need) == sorted(need) and need[0] < bayes_minhash.BATCH and need[-1] > 80
    a = np.zeros((2, bayes_minhash.CHECKED), "u2")
    b = a.copy()
    b[0, : bayes_minhash.CHECKED // 2] = 1
    assert bayes_minhash.survive(a, b).tolist() == [False, True]


def test_posterior_by_integration():
    """The least matches are where the posterior's tail reaches the miss probability."""
    t = np.linspace(0, 1, 200_001)
    for n, m in zip((16, 64, 128), (bayes_minhash.least_matches()[i] for i in (0, 3, 7)), strict=True):
        tails = []
        for k in (m - 1, m):
            density = t**k * (1 - t) ** (n - k)
            tails.append(density[t >= 0.85].sum() / density.sum())
        assert tails[0] < bayes_minhash.MISS <= tails[1]


def test_exactly_the_threshold_links():
    a = np.arange(20, dtype="u8")
    assert bayes_minhash.linked(a, np.arange(17, dtype="u8"))
    assert not bayes_minhash.linked(a, np.append(np.arange(17, dtype="u8"), np.uint64(99)))
    assert not bayes_minhash.linked(a[:0], a[:0])


def test_nulls_empty_copies_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [
        (5, text, "x"), (5, text, "y"), (3, text.upper(), ""), (None, text, ""), (7, None, ""), (8, "", ""), (7, None, ""),
        (9, " \n", ""), (10, "one two", ""), (11, "ONE  two", ""), (None, "alone here", ""), (12, "é É", ""), (13, "é é", ""),
        (14, "word " * 30_000, ""), (14, "other", ""),
    ]
    found = bayes_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in found)
    assert got == [
        (0, 1, 0, True), (0, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (7, 0, 7, True), (7, 0, 7, True),
        (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (13, 1, 13, True),
        (14, 1, 14, True), (14, 1, 14, True),
    ]
    assert run(spark, []) == {}
