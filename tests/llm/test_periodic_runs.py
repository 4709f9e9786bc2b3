"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import plain
from conftest import TESTDATA
from quaestor.llm import periodic_runs, queries


def drawn(draw):
    """Words with runs of all scales, also ones that touch or nest, among other words."""
    ws = []
    for _ in range(draw.randrange(1, 5)):
        few = draw.choice((2, 3, 50, 1000))
        if draw.random() < 0.4:
            ws += [draw.randrange(few) for _ in range(draw.randrange(80))]
        else:
            q = draw.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100))
            base = [draw.randrange(few) for _ in range(q)]
            ws += (base * 8)[: draw.randrange(q, 5 * q + 30)]
    return ws


def test_runs_as_of_every_period():
    draw, some = random.Random(3), 0
    for _ in range(400):
        ws = drawn(draw)
        expected = plain.periodic_runs(ws)
        assert [tuple(map(int, r)) for r in periodic_runs.run_table(np.array(ws, "i8"))] == expected
        some += len(expected)
    assert some > 250


def test_small_blocks_at_large_scales(monkeypatch):
    monkeypatch.setattr(periodic_runs, "LARGEST_BLOCK", 16)
    monkeypatch.setattr(periodic_runs, "TRANSFORM", 128)
    draw = random.Random(4)
    for _ in range(60):
        ws = drawn(draw)
        assert [tuple(map(int, r)) for r in periodic_runs.run_table(np.array(ws, "i8"))] == plain.periodic_runs(ws)


def test_words_that_share_a_number_make_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SPREAD", np.uint64(1))  # all words become number 0
    draw = random.Random(5)
    for _ in range(40):
        ws = drawn(draw)
        assert [tuple(map(int, r)) for r in periodic_runs.run_table(np.array(ws, "i8"))] == plain.periodic_runs(ws)


@pytest.mark.parametrize("b", [8, 64, 1024])
def test_transform_finds_where_squared_differences_vanish(b):
    draw = np.random.default_rng(b)
    blocks = draw.integers(0, 900, (5, b), dtype="u8")
    windows = draw.integers(0, 900, (5, 2 * b), dtype="u8")
    for row, at in enumerate((0, 1, b // 2, b - 1)):
        windows[row, at : at + b] = blocks[row]
    slices = np.lib.stride_tricks.sliding_window_view(windows, b, axis=1)[:, :b]
    expected = (slices == blocks[:, None]).all(2)
    assert (periodic_runs.returns(blocks, windows) == expected).all() and expected.sum() >= 4


def test_long_texts_of_one_word_and_of_long_periods():
    for n, q in ((200_000, 1), (200_000, 60_000), (150_000, 49_999)):
        assert periodic_runs.run_table(np.arange(n) % q).tolist() == [[0, n, q]]


def expected_row(doc_id, text):
    ws = plain.re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
    runs = plain.periodic_runs(ws)
    best = min(runs, key=lambda r: (-plain.Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = [
        hashlib.sha256(x.encode()).hexdigest()
        for x in ("".join("%d,%d,%d\n" % r for r in runs), " ".join(w for i, w in enumerate(ws) if i not in gone))
    ]
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


def test_query_as_plain_python_over_a_whole_table(spark):
    folder = f"{TESTDATA}/sf0.001"
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = queries.op13_periodic_runs(spark, folder).collect()
    got = {r.doc_id: tuple(r)[1:] for r in found}
    assert found[0].__fields__ == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert len(found) == len(docs)
    assert got == {d["doc_id"]: expected_row(d["doc_id"], d["text"]) for d in docs}
    assert sum(r.n_runs > 0 for r in found) >= 10


def test_nulls_empty_repeats_clashing_columns_and_an_empty_table(spark):
    often = " ".join(["spam"] * 30 + ["other"])
    rows = [(1, often, "x"), (1, often, "x"), (None, often, None), (2, None, "y"), (3, "", ""), (4, " \n\t", ""), (5, "Aa aA", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "n_words")
    found = periodic_runs.periodic_runs(df.withColumn("period", df["doc_id"]))
    assert found.columns == ["doc_id", "period", "n_words", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    assert got == [
        (0, 31, [(0, 30, 1)], "spam other"), (1, 31, [(0, 30, 1)], "spam other"), (1, 31, [(0, 30, 1)], "spam other"),
        (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 2, [], "Aa aA"),
    ]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_do_not_go_over_to_the_next_text(spark):
    rows = [(i, "a b " * 11) for i in range(6)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert all(r.runs == [] for r in found.collect())
