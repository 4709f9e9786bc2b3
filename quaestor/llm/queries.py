"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaestor.llm import (
    bayes_minhash, decontamination, language_id, licences, line_dedup, neighbours, partenum, periodic_runs, prefix_trie,
    quality, sanitisation, sentencepiece_viterbi, warc,
)
from quaestor.llm.common import SPACES, let, table, text_of

#: Place of the public tokenizer's model; a parameter of the operators.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = sentencepiece_viterbi.encode_documents(docs, MODEL_FILE, decoded="decoded")
    return decoded.select(
        "doc_id", "n_tokens", "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines of windows that occurred before."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document's set of word shingles."""
    found = partenum.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that a document states."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the share of its shingles."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def remainder(divisor: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("lang_best").alias("lang_pred"), "score",
        (F.col("lang_pred") == language_id.UNKNOWN).alias("narrow"),
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, written to archives and read back."""
    found = warc.captures_of(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, and the terms that reveal it."""
    found = sanitisation.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(sanitisation.PATTERNS))

    def count(place: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == place)).cast("long").alias(f"n_{kind}")

    counts = [count(place, kind) for place, kind in enumerate(sanitisation.PATTERNS)]
    return found.select(
        "doc_id", *counts, F.sha2(sanitisation.span_text(base), 256).alias("base_sha256"),
        sanitisation.span_text(F.col("spans")).alias("spans"),
    )


def op11_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document's set of word shingles, and whether it stays."""
    return bayes_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def id_hash(column: str) -> Column:
    """crc32 of a number's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def with_shared_beginnings(conversations: DataFrame) -> DataFrame:
    """Up to five first turns, by a hash of the id, are those of the conversation that begins its hundred."""
    h = (id_hash("conv_id") % 6).cast("int")
    heads = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    none = F.array().cast(prefix_trie.TURNS)
    return (
        conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
        .join(heads, "base", "left")
        .select("conv_id", F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))
        ).alias("turns"))
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    conversations = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(with_shared_beginnings(conversations))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, drawn by id, repeat a stretch of their words up to their end."""
    h = id_hash("doc_id")
    g = F.floor(h / 10)

    def repeating(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p)))

    ws = F.filter(F.split(text_of(), SPACES), lambda w: w != "")
    planted = let(ws, lambda found: F.when(F.size(found) > 0, F.array_join(repeating(found), " ")))
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every text, the strongest of them, and the text without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(with_planted_runs(docs))

    def stronger(x: Column, y: Column) -> Column:
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        earlier = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))
        return F.when((more > less) | ((more == less) & earlier), -1).otherwise(1)

    best = F.get(F.array_sort("runs", stronger), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[f].alias(f) for f in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_licences": op4_licences,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op7_neighbours": op7_neighbours,
        "op8_warc": op8_warc,
        "op9_quality": op9_quality,
        "op10_sanitisation": op10_sanitisation,
        "op11_bayes_minhash": op11_bayes_minhash,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_periodic_runs": op13_periodic_runs,
    }
