"""Personal data against plain patterns, and the terms that reveal it."""

import random

import plain
from quaestor.llm import sanitisation as san

SCHEMA = "doc_id long, text string, spans int"


def base(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", san.base_spans(san.text_of()).alias("s")).collect()
    found = {r.doc_id: [(san.KINDS[s.kind], s.start, s.end) for s in r.s] for r in rows}
    return [found[i] for i in range(len(texts))]


ODD = [
    None, "", "a@b", "a@b.c_x@d.e.f@g.h", "a@b.c.", "@b.c", "x..y@z-.-.q", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3.4",
    "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5", "+1 (555) 123-4567",
    "+1..........", "++12 34 56 78", "😀é a@b.co 😀 +49 30 1234567", "9" * 5000, "1 " * 5000, "a.b" * 3000 + "@", "a@" + "b." * 4000 + "c",
    "a@b.c " * 700, "+" * 3000, "+1" + "." * 5000, " ".join(["4111111111111111"] * 300),
]


def test_odd_texts_as_the_plain_patterns(spark):
    assert base(spark, ODD) == [plain.base_spans(t) for t in ODD]


def test_random_texts_as_the_plain_patterns(spark):
    draw = random.Random(4)
    parts = ["a", "@", ".", "b.c", "1", "255", "256", "-", " ", "+", "(", ")", "4111111111111111", "😀", "_", "\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(1500)]
    assert base(spark, texts) == [plain.base_spans(t) for t in texts]


def test_running_totals(spark):
    lengths = [list(range(n)) for n in (0, 1, 127, 128, 129, 300)]
    df = spark.createDataFrame([(x,) for x in lengths], "x array<bigint>")
    for row, own in zip(df.select(san.running_totals(san.F.col("x")).alias("t")).collect(), lengths):
        assert row.t == [sum(own[: i + 1]) for i in range(len(own))]


def test_terms_that_only_occur_with_an_entity_go(spark):
    rows = [(i, "write to Zanzibar office at a0@b.co in the town", i) for i in range(8)]
    rows += [(100 + i, "in the town we write to the office at noon", 0) for i in range(60)]
    rows += [(None, None, 0), (200, "", 0), (201, "no such data", 0), (0, rows[0][1], 0)]
    found = {}
    for r in san.sanitise(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.doc_id, r)
    one = found[0]
    text = rows[0][1]
    assert [(san.KINDS[s.kind], text[s.start : s.end]) for s in one.spans] == [("email", "a0@b.co"), ("term", "Zanzibar")]
    assert "Zanzibar" not in one.sanitised_text and "[email]" in one.sanitised_text and "town" in one.sanitised_text
    assert found[100].spans == [] and found[100].sanitised_text == rows[8][1]
    assert found[None].sanitised_text is None and found[200].sanitised_text == "" and found[201].spans == []


def test_overlapping_spans_and_no_rows(spark):
    df = spark.createDataFrame([(1, "call +49 10.20.30.40 now", 0)], SCHEMA)
    (row,) = san.sanitise(df).collect()
    assert [san.KINDS[s.kind] for s in row.spans] == ["ip", "phone"]
    assert row.sanitised_text == "call [phone] now"
    assert san.sanitise(df.limit(0)).count() == 0


def test_revealing_terms_go_wherever_they_stand(spark):
    """Far from the entity, a second time, and in a document that does not hold the entity."""
    far = "in the town we write to the office at noon " * 6
    rows = [(i, f"Zanzibar {far} a0@b.co {far} Zanzibar", i) for i in range(8)]
    rows += [(50, "only Zanzibar here", 0), (51, "zanzibar@c.de in the town", 0)]
    rows += [(100 + i, far, 0) for i in range(990)]
    found = {r.doc_id: r for r in san.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}

    def spans(i, text):
        return [(san.KINDS[s.kind], text[s.start : s.end]) for s in found[i].spans]

    assert spans(0, rows[0][1]) == [("email", "a0@b.co"), ("term", "Zanzibar"), ("term", "Zanzibar")]
    assert found[0].sanitised_text.count("Zanzibar") == 0 and found[0].sanitised_text.count("town") == 12
    assert spans(50, rows[8][1]) == [("term", "Zanzibar")] and "Zanzibar" not in found[50].sanitised_text
    assert spans(51, rows[9][1]) == [("email", "zanzibar@c.de")]
    assert found[100].spans == []


def test_terms_beside_personal_data_and_in_odd_runs(spark):
    """A term that ends where personal data begins; runs with digits first, other case, and letters beyond 16 bits."""
    far = "in the town we write to the office at noon " * 6
    rows = [(i, f"Zanzibar {far} a0@b.co", i) for i in range(8)]
    cut = "see Zanzibar4111111111111111 now"
    odd = "12Zanzibar ZANZIBAR zanzibars 3a4zanzibar 𐀀Zanzibar Zanzibar𐀀 _Zanzibar_ zan Zanzibar"
    rows += [(50, cut, 0), (51, odd, 0)] + [(100 + i, far, 0) for i in range(990)]
    found = {r.doc_id: r for r in san.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(san.KINDS[s.kind], cut[s.start : s.end]) for s in found[50].spans] == [("card", "4111111111111111"), ("term", "Zanzibar")]
    assert [(s.start, odd[s.start : s.end]) for s in found[51].spans] == [
        (2, "Zanzibar"), (11, "ZANZIBAR"), (odd.index("_Z") + 1, "Zanzibar"), (len(odd) - 8, "Zanzibar"),
    ]


def test_positions_are_taken_for_revealing_terms_only(spark, monkeypatch):
    taken = []
    own = san.matches
    monkeypatch.setattr(san, "matches", lambda text, pattern: taken.append(pattern) or own(text, pattern))
    san.all_spans(spark.createDataFrame([(1, "call a@b.co", 0)], SCHEMA))
    assert san.TERM not in [p for p in taken if isinstance(p, str)]
