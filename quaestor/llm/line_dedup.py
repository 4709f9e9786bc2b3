"""Line dedup: three-line windows that occurred before are removed from the text.

The lines of every document are taken in overlapping windows of three. A window's first occurrence
is that of the smallest (doc_id, text key, position); every later one covers its three lines, in the
same document too. Covered positions are merged and their lines leave. So each line that leaves has
an equal line that stays earlier on.

Windows are counted with map-side sums, so a window that a third of the documents share is one row
per task there. The second join is on the window alone and is left to the adaptive skew split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quaestor.llm.common import let, text_key, text_of

WIDTH = 3


def lines_of(text: Column) -> Column:
    """The parts between line feeds; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, doc_key, position, h1, h2: each window of consecutive lines by 128 bits of hash."""
    def hashes(lines: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [F.get(lines, i + k) for k in range(width)]
            return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(width), *parts).alias("h2"))

        return F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(0), F.size(lines) - width), one))

    text = text_of()
    hashed = docs.select("doc_id", text_key(text).alias("doc_key"), let(lines_of(text), hashes).alias("hashes"))
    return (
        hashed.select("doc_id", "doc_key", F.posexplode_outer("hashes").alias("position", "hash"))
        .filter(F.col("position").isNotNull())
        .select("doc_id", "doc_key", "position", "hash.h1", "hash.h2")
    )


def later_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, doc_key, positions: where windows begin that occurred before."""
    all_windows = windows(docs, width)
    place = F.struct("doc_id", "doc_key", "position")
    repeated = (
        all_windows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )
    return (
        all_windows.join(repeated, ["h1", "h2"])
        .filter(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "doc_key")
        .agg(F.collect_set("position").alias("positions"))
    )


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their text less repeated windows, and n_lines, n_removed.

    Windows of blank lines count like others. Texts of fewer lines than `width` stay as they are.
    Rows that repeat an id and a text are one document and come out alike; rows that share an id
    only are ordered by text key. A null id comes before all others. A null text stays null and an
    empty one empty, with no or one line and nothing removed. Other columns are kept, but for
    n_lines and n_removed, which are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    found = later_windows(docs, width).select(
        F.col("doc_id").alias("found_id"), F.col("doc_key").alias("found_key"), "positions"
    )
    keyed = docs.select(
        F.struct(*kept).alias("row"), F.col("doc_id").alias("own_id"),
        F.col("text"), text_key(text_of()).alias("own_key"),
    )
    joined = keyed.join(
        found, F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_key") == F.col("found_key")), "left"
    )
    def rest(lines: Column) -> Column:
        covered = F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (width - 1))))
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(
            F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lines).alias("n_lines"),
            F.array_size(places).alias("n_left"),
        )

    left = joined.withColumn("rest", F.when(F.col("positions").isNotNull(), let(lines_of(F.col("text")), rest)))
    n_lines = F.coalesce(F.col("rest.n_lines"), F.size(lines_of(F.col("text"))))
    return left.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce(F.col("rest.text"), F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("rest.n_lines") - F.col("rest.n_left"), F.lit(0)).cast("long").alias("n_removed"),
    )
