"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items are looked for inside long documents. An item's sketch holds its smallest
shingle hashes, as MinHash orders them: with `q` shingles of which `need` must be in the document,
the `q - need + 1` smallest. A document that has `need` shingles of the item has at least one of
the sketch, whatever its length, so no containing document is missed. Documents are partitioned by
size (powers of two of their shingle count), and an item is searched only in partitions whose
largest size can hold what it needs. Candidates are verified by exact shingle containment.

A document's side isn't cut to a sketch: an item of 30 shingles is a thousandth of a long document
and would fall out of any sketch of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaestor.llm.common import shingles, small, text_key, text_of, written

THRESHOLD = 0.8
WIDTH = 5


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """item_id, size, need, hash, in_sketch: one row per distinct shingle of each item's text."""
    texts = items.select("item_id", text_of().alias("text")).distinct()
    keyed = texts.withColumn("item_key", text_key(F.col("text")))
    sets = keyed.select("item_id", "item_key", F.array_sort(shingles(F.col("text"), width)).alias("hashes"))
    size = F.size("hashes")
    # the margin keeps 0.8 * 5 = 4.000000000000001 from asking for five
    sized = sets.withColumn("size", size).withColumn(
        "need", F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int")
    )
    return sized.select(
        "item_id", "item_key", "size", "need", F.posexplode_outer("hashes").alias("place", "hash")
    ).select(
        "item_id", "item_key", "size", "need", "hash",
        (F.col("place") <= F.col("size") - F.col("need")).alias("in_sketch"),
    ).filter(F.col("hash").isNotNull())


def held_items(docs: DataFrame, items: DataFrame, threshold: float, width: int, *place: str) -> DataFrame:
    """The columns `place` of each row of documents, and the items it holds: item_id, size, matched."""
    searched = small(written(item_shingles(items, threshold, width)))
    sets = docs.select(
        *place, F.monotonically_increasing_id().alias("row"), shingles(text_of(), width).alias("hashes")
    )
    # size_below: the largest size in the document's partition, and one
    sized = sets.select(
        *place, "row",
        F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes"))) + 1).alias("size_below"),
        F.explode_outer("hashes").alias("hash"),
    )
    hits = sized.join(searched, "hash").filter(F.col("size_below") > F.col("need"))
    found = hits.groupBy(*place, "row", "item_id", "item_key", "size", "need").agg(
        F.count(F.lit(1)).alias("matched"), F.max("in_sketch").alias("candidate")
    )
    return found.filter(F.col("candidate") & (F.col("matched") >= F.col("need")))


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """doc_id, item_id, matched, containment: every document that holds `threshold` of an item's
    distinct shingles, and how many of them.

    Null or empty texts hold nothing, on either side. Fewer words than `width` make one shingle.
    Rows that share an id are compared one by one and the best counts; repeated rows give one row.
    A null id stays null. Other columns are ignored.
    """
    return (
        held_items(docs, items, threshold, width, "doc_id")
        .withColumn("containment", F.col("matched") / F.col("size"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("containment").alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents that hold no item, told apart by id and text. A null id is compared as a value."""
    keyed = docs.select("doc_id", "text", text_key(text_of()).alias("doc_key"))
    held = held_items(keyed, items, threshold, width, "doc_id", "doc_key")
    dirty = written(held.select(F.col("doc_id").alias("dirty_id"), F.col("doc_key").alias("dirty_key")).distinct())
    same = docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (text_key(text_of()) == dirty["dirty_key"])
    return docs.join(small(dirty), same, "left_anti")
