"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaestor.llm import decontamination, line_dedup, partenum, quality, sentencepiece_viterbi
from quaestor.llm.common import table, written
from quaestor.llm.queries import MODEL_FILE, remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects leave. It learns outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(~F.coalesce(remainder(5) == 0, F.lit(False)))
    model = quality.fit(docs, labels)
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occurred before leave; every document stays."""
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near equal texts, that of the smallest id stays."""
    return partenum.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item leave."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the documents, and whether they decode to the text."""
    decoded = sentencepiece_viterbi.encode_documents(docs, MODEL_FILE, decoded="decoded")
    return decoded.withColumn("round_trip", F.col("decoded") == F.col("text")).drop("decoded")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", one_per_group),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Stages 1, 3 and 5 are not expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = written(docs)
    return docs
