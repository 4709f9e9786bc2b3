"""Helpers of joins on pairs: values beside both ends, own elements of sets."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quaestor.llm.common import map_arrow, small, written

#: Pairs of one text in a task.
DEGREE = 256
#: Bytes of the pairs of full sets that a worker holds at once.
BATCH_BYTES = "16m"


@contextmanager
def arrow_bytes(spark: SparkSession, limit: str):
    """Arrow batches of at most so many bytes, or one row, in what runs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def busy_texts(pairs: DataFrame) -> DataFrame:
    """k, parts: texts of more than DEGREE written pairs (a, b), and how many parts to deal these to."""
    ends = pairs.select(F.col("a").alias("k")).unionAll(pairs.select("b"))
    degrees = ends.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DEGREE)
    return small(written(degrees.select("k", F.ceil(F.col("n") / DEGREE).cast("int").alias("parts"))))


def beside(pairs: DataFrame, values: DataFrame, column: str, busy: DataFrame) -> DataFrame:
    """Pairs (a, b) with a column of a and of b. Pairs of a busy text (k, parts) go to so many parts,
    to each of which its row is copied."""
    copied = values.join(busy, "k", "left").select(
        "k", column, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    for side, other in ("ab", "ba"):
        own = copied.select(F.col("k").alias(side), "part", F.col(column).alias(f"{column}_{side}"))
        dealt = pairs.join(busy.withColumnRenamed("k", side), side, "left").withColumn(
            "part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
        )
        pairs = dealt.drop("parts").join(own, [side, "part"]).drop("part")
    return pairs


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            sets = [np.frombuffer(x.as_buffer(), "i8") for x in part.column("hashes")]
            keys = np.repeat(part.column("k").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(sets))], names=["k", "h"])


def own_counts(sets: DataFrame) -> DataFrame:
    """k, u: how many elements of a set no other one has."""
    rows = map_arrow(sets, _elements, "k long, h long")
    alone = rows.groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("other")).filter("k = other")
    return alone.groupBy("k").agg(F.count(F.lit(1)).alias("u"))
