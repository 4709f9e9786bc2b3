"""Three-line windows against a plain version."""

import random

import plain
from quaestor.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string"


def run(spark, rows, schema=SCHEMA):
    return dedup_lines(spark.createDataFrame(rows, schema)).collect()


def test_random_lines_as_the_plain_version(spark):
    draw = random.Random(2)
    docs = [(d, "\n".join(draw.choice("abcd") for _ in range(draw.randrange(1, 14)))) for d in range(120)]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in run(spark, docs)}
    assert found == plain.dedup_lines(docs)
    assert any(removed for _, _, removed in found.values())


def test_overlaps_merge_and_the_first_stays(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\na\na\na\na"), (4, "a\nb")]
    assert {r.doc_id: r.text for r in run(spark, rows)} == {1: "a\nb\nc\nd", 2: "x\ny", 3: "a", 4: "a\nb"}


def test_nulls_empty_copies_and_clashing_columns(spark):
    rows = [
        (None, "a\nb\nc", 5), (1, "a\nb\nc", 5), (1, "a\nb\nc", 6), (2, None, 1), (3, "", 1), (4, "\n\n\n\n", 1),
    ]
    found = run(spark, rows, SCHEMA + ", n_lines int")
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in found if r.text is not None) == [
        (0, "a\nb\nc", 3, 0), (1, "", 3, 3), (1, "", 3, 3), (3, "", 1, 0), (4, "", 5, 4),
    ]
    (null,) = [r for r in found if r.text is None]
    assert (null.doc_id, null.n_lines, null.n_removed) == (2, 0, 0)
    assert run(spark, [], SCHEMA) == []


def test_a_long_text(spark):
    lines = [str(i % 5000) for i in range(20_000)]
    (row,) = run(spark, [(1, "\n".join(lines))])
    assert row.text == "\n".join(lines[:5000]) and row.n_removed == 15_000
