"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np

import plain
from quaestor.llm import partenum
from quaestor.llm.components import components


def corpus(seed, n, words):
    """Texts in families: near copies around the threshold, exact ones, and a shared passage."""
    draw = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(9))
    docs = []
    while len(docs) < n:
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(1, words))]
        for _ in range(draw.randrange(1, 7)):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 1, 2, 4))):
                own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
            text = " ".join(own[: len(own) - draw.choice((0, 0, 1))])
            docs.append((shared + " " if draw.random() < 0.3 else "") + text)
    return list(enumerate(docs[:n]))


def run(spark, docs):
    found = partenum.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def test_components_as_all_pairs(spark):
    docs = corpus(1, 220, 120)
    expected = plain.near_duplicates(docs)
    assert run(spark, docs) == expected
    assert len({c for _, c in expected.values()}) < len(docs) - 40


def test_blocks_marks_and_own_elements_rule_out_no_link(spark, monkeypatch):
    """All buckets are crowded and of many blocks, marks often have nothing in common, one turn of pivots."""
    monkeypatch.setattr(partenum, "CROWD", 1)
    monkeypatch.setattr(partenum, "BLOCK", 2)
    monkeypatch.setattr(partenum, "MARKS", 1)
    monkeypatch.setattr(partenum, "TURNS", 1)
    docs = corpus(4, 160, 60)
    assert run(spark, docs) == plain.near_duplicates(docs)


def test_edited_copies_of_one_text(spark):
    """Two hundred texts with edits from few words, their similarities around the threshold."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(200):
        own = list(base)
        for _ in range(draw.randrange(0, 5)):
            own[draw.randrange(len(own))] = f"e{draw.randrange(6)}"
        docs.append((i, " ".join(own)))
    assert run(spark, docs) == plain.near_duplicates(docs)


def test_sets_that_link_share_a_signature_and_pass_the_sketch():
    draw = np.random.default_rng(1)
    for size in [*range(1, 60), 75, 100, 150, 250, 400, 700, 1500]:
        for _ in range(6):
            a = np.unique(draw.integers(0, 2**63, size, dtype="u8"))
            change = draw.integers(0, len(a) // 9 + 1)  # 0.8 is 8/9 kept on both sides
            b = np.unique(np.concatenate([a[change:], draw.integers(0, 2**63, change, dtype="u8")]))
            for x, y in ((a, b), (a, a[: -(-len(a) * 4 // 5)])):
                if partenum.linked(x, y):
                    for seed in (0, 1):
                        assert len(np.intersect1d(partenum.signatures(x, seed), partenum.signatures(y, seed)))
                    args = partenum.parity_sketch(x), partenum.parity_sketch(y), len(x), len(y)
                    assert partenum.may_link(*args)


def test_exactly_the_threshold_links():
    a = np.arange(9, dtype="u8")
    assert partenum.linked(a, np.arange(1, 10, dtype="u8"))  # 8 of 10
    assert not partenum.linked(a, np.append(np.arange(1, 9, dtype="u8"), np.array([20, 21], "u8")))


def test_nulls_empty_copies_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [
        (5, text, "x"), (5, text, "y"), (3, text.upper(), ""), (None, text, ""), (7, None, ""), (8, "", ""),
        (9, " \n", ""), (10, "one two", ""), (11, "ONE  two", ""), (None, "alone here", ""), (12, "é É", ""), (13, "é é", ""),
    ]
    found = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found)
    assert got == [
        (0, 1, 0), (0, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 0, 7), (8, 0, 8), (9, 0, 9),
        (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 13),
    ]
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k string"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 7, 8, 9, 10, 12, 13]
    assert run(spark, []) == {}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
