"""Compression language ID: held-out accuracy, rejection and odd texts."""

from pyspark.sql import functions as F

from conftest import TESTDATA
from quaestor.llm import language_id
from quaestor.llm.queries import op6_language_id

FOLDER = str(TESTDATA / "sf0.01")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    found = op6_language_id(spark, FOLDER)
    right = found.join(docs, F.col("doc_id") == F.col("id")).filter("held_out")
    n, ok = right.select(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 200 and ok / n >= 0.95
    assert found.count() == docs.count() and found.filter("score < 0 OR score > 1").count() == 0


def test_odd_texts_and_rejection(spark):
    english = "the cat and the dog are in the house with their friends " * 20
    german = "der hund und die katze sind mit ihren freunden in dem haus " * 20
    labelled = spark.createDataFrame(
        [("en", english), ("de", german), ("de", german), (None, "x"), ("fr", None), ("fr", "123")], "lang string, text string"
    )
    model = language_id.fit(labelled)
    assert list(model.dictionaries) == ["de", "en"]
    rows = [(1, "the dog and the cat", "de"), (2, "die katze und der hund", "en"), (3, None, "en"), (4, "", "en"),
            (5, "12 + 34!", "en"), (6, "qqq", "en"), (7, english * 50, "de"), (1, "the dog and the cat", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [found[i].lang_best for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert found[6].lang_best == "de" and found[6].lang_pred == "und"  # equal sizes: first by name, rejected
    assert found[3].score == 0 and found[7].score > 0.99
    assert language_id.identify(df.limit(0), model).count() == 0
    nothing = language_id.fit(labelled.limit(0))
    assert {r.lang_best for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_copies_do_not_fill_a_dictionary(spark):
    rows = [("en", "copy of one text")] * 2000 + [("en", f"other text number {chr(97 + i % 26) * 5}") for i in range(26)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.dictionaries["en"].count(b"copy") == 1 and model.dictionaries["en"].count(b"other") == 26


def test_numbers_that_are_no_digits_are_no_letters(spark):
    model = language_id.LanguageModel({"de": b"der hund", "en": b"the dog"})
    assert [model.predict(t)[0] for t in ("½ ²", "Ⅷ", "①", "٣ _")] == ["und"] * 4
    assert "und" not in [model.predict(t)[0] for t in ("½ dog", "ªº")]  # these hold letters


def test_a_language_of_many_copies_is_learned_from_its_other_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 20)
    rows = [("en", "copy of one text")] * 20_000 + [("en", f"other text {chr(97 + i % 26) * (1 + i // 26)}") for i in range(100)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.dictionaries["en"].count(b"text") == 20
