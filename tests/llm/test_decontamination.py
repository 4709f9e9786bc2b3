"""Containment search against all pairs."""

import random

import plain
from quaestor.llm import decontamination


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, hash int"), spark.createDataFrame(items, "item_id long, text string, size int")


def test_short_items_in_long_documents(spark):
    draw = random.Random(1)
    word = lambda: f"w{draw.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 30))), 0) for i in range(40)]
    docs = []
    for d in range(60):
        own = [word() for _ in range(draw.randrange(1, 400))]
        _, text, _ = draw.choice(items)
        own[len(own) // 2 : len(own) // 2] = text.upper().split()[draw.choice((0, 0, 1, 2)) :]
        docs.append((d, "  ".join(own), 0))
    found = {(r.doc_id, r.item_id): r.matched for r in decontamination.leaks(*frames(spark, docs, items)).collect()}
    expected = plain.leaks([d[:2] for d in docs], [i[:2] for i in items])
    assert found == expected and len(found) > 20


def test_nulls_empty_copies_ties_and_short_items(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten, 0), (1, ten, 0), (2, None, 0), (3, "", 0), (4, "two words", 0), (None, "x y z u v", 0)]
    docs = [
        (1, "q " + ten + " r", 0), (1, "q " + ten + " r", 0), (2, None, 0), (3, "", 0), (4, "Two\nwords", 0),
        (5, "two words more", 0), (None, ten, 0), (6, "x y z u v w", 0), (7, "a b c d e f g h", 0),
    ]
    d, i = frames(spark, docs, items)
    found = sorted((r.doc_id or 0, r.item_id or 0, r.matched, r.containment) for r in decontamination.leaks(d, i).collect())
    assert found == [(0, 1, 6, 1.0), (1, 1, 6, 1.0), (4, 4, 1, 1.0), (6, 0, 1, 1.0)]
    assert sorted(r.doc_id for r in decontamination.clean(d, i).collect()) == [2, 3, 5, 7]
    assert decontamination.leaks(d, i.limit(0)).count() == 0 and decontamination.leaks(d.limit(0), i).count() == 0
    assert decontamination.clean(d, i.limit(0)).count() == 9


def test_clean_rows_stay_beside_dirty_ones_of_their_id(spark):
    item = "one two three four five six seven eight"
    rows = [(None, item), (None, "clean"), (None, None), (1, f"so {item} so"), (1, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontamination.clean(docs, items).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, "clean"), (None, None), (1, "clean too")}
