"""Licence scans: notices, full texts in other forms, and nothing else."""

from quaestor.llm import licences
from quaestor.llm.licence_templates import TEMPLATES

FULL = {(name, form): text for name, form, text in TEMPLATES}


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, licence int")
    return sorted((r.doc_id or 0, r.licence, round(r.dice, 3), r.line) for r in licences.scan(df).collect())


def test_notices_and_texts(spark):
    mit = FULL["MIT", "full"]
    rows = [
        (1, "some words here\nreleased under the MIT licence\nReleased under the MIT License!\nmore", 0),
        (2, "intro line\n\n" + mit.replace("\n\n", "\n").upper() + "\n\nother text", 0),
        (3, mit, 0),
        (4, "nothing to see\nall rights\nreserved words are not alone", 0),
        (5, "All rights reserved.", 0), (5, "All rights reserved.", 0),
        (6, None, 0), (7, "", 0), (8, "word", 0), (None, "Licensed under CC BY-NC 4.0.", 0),
        (9, FULL["BSD-2-Clause", "full"].replace("\n", " "), 0),
    ]
    found = scan(spark, rows)
    assert found == [
        (0, "CC-BY-NC-4.0", 1.0, 0), (1, "MIT", 1.0, 2), (2, "MIT", found[2][2], None), (3, "MIT", 1.0, None),
        (5, "reserved", 1.0, 0), (9, "BSD-2-Clause", 1.0, 0),
    ] + [x for x in found if x[:2] == (9, "BSD-3-Clause")]
    assert found[2][2] >= 0.99


def test_no_rows(spark):
    assert scan(spark, []) == []


def test_sizes_that_reach_the_threshold(spark):
    (row,) = spark.range(1).select(licences.admissible(licences.F.lit(6), 0.8).alias("n")).collect()
    reach = [n for n in range(1, 20) if 2 * min(n, 6) / (n + 6) >= 0.8 - 1e-12]
    assert row.n == reach
