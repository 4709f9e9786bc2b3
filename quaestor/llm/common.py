"""Helpers the corpus operators share: tables, row keys, words and tables kept in the shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 1_000_000

#: White space between words, as a character class of Java, Python and RE2 patterns.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder all executors share: the session's `spark.checkpoint.dir`.

    Only where that is unset in a local session, a folder of our own is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: computed once, lineage cut.

    The files outlive lost executors. They are removed with the shared folder.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cheap, already written frame, with a broadcast hint only if its count allows it."""
    return F.broadcast(df) if df.count() <= rows else df


_SHIPPED: set[str] = set()


def ship_package(context: SparkContext) -> None:
    """Send this package to executors, which may not have it installed."""
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, one row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("f8")))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + size, side="right")))
        yield start, end
        start = end


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow, where executors know this package."""
    ship_package(df.sparkSession.sparkContext)
    return df.mapInArrow(run, schema)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """64 bits that stand for a whole text; tells apart rows that share an id."""
    return F.xxhash64(text)


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row.

    A name given by select() isn't enough: the optimizer may move a later filter, one that it adds
    for explode() too, below it and puts the whole expression into each step of a loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of all runs of `width` words; fewer words give one shingle, none give
    none."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        runs = F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]),
        )
        short = F.array(F.xxhash64(F.lit("short"), F.array_join(ws, " ")))
        return F.when(n >= width, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(words(text), of))
