"""The quality classifier: held-out accuracy, calibration and odd input."""

import numpy as np
from pyspark.sql import functions as F

from conftest import TESTDATA
from quaestor.llm import quality
from quaestor.llm.queries import op9_quality

FOLDER = str(TESTDATA / "sf0.1")


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    found = op9_quality(spark, FOLDER)
    rows = found.join(labels, F.col("doc_id") == F.col("id")).filter("held_out").toPandas()
    good = rows["quality"] == 1
    assert len(rows) > 500 and (rows["predicted"] == rows["quality"]).mean() >= 0.95
    assert (rows.loc[good, "predicted"] == 1).mean() >= 0.99
    loss = -np.log(np.clip(np.where(good, rows["score"], 1 - rows["score"]), 1e-9, 1)).mean()
    assert loss < 0.2
    assert found.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0


def test_odd_texts_score_alike_and_clashing_columns_go(spark):
    docs = spark.createDataFrame(
        [(i, "good plain words in a row here " * 5 if i % 2 else "!!! ### $$$ " * 9) for i in range(200)], "doc_id long, text string"
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    labels = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (3, None), (9999, 0)], labels.schema))
    model = quality.fit(docs, labels)
    rows = [(1, "good plain words", "x"), (1, "good plain words", "y"), (2, "### !!!", ""), (3, None, ""), (4, "", ""),
            (5, "good plain words in a row here " * 30_000, ""), (6, "\n \t", "")]
    found = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    by_id = {r.doc_id: r for r in found}
    assert found[0].score == found[1].score and by_id[1].predicted == 1 and by_id[2].predicted == 0
    assert by_id[3].score == by_id[4].score == by_id[6].score and by_id[5].predicted == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds_the_score_is_their_share(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5, 0.5]
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, one).collect()] == [0.75, 0.75]


def test_a_long_text_is_pooled_as_in_one_step(monkeypatch):
    terms, vectors = quality.word_vectors(["a b c d. a b! a b c"] * 9)
    model = quality.QualityModel(0.5, terms, vectors)
    texts = ["a b c " * 50, "", "d. ! a", None, "b " * 77]
    whole = model.pooled(texts, quality.Terms(terms))
    monkeypatch.setattr(quality, "PART_CHARS", 7)
    assert np.allclose(model.pooled(texts, quality.Terms(terms)), whole, atol=1e-5)
    assert not whole[1].any() and not whole[3].any()


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(1)
    z = draw.normal(0, 1, 4000)
    y = (draw.random(4000) < 1 / (1 + np.exp(-z))).astype("f8")
    assert 2.3 < quality.temperature(3 * z, y) < 4
