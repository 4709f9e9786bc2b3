"""Tables and views: save, read, describe, count, peek and sample."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaestor.functions.frames import stacked
from quaestor.schemas import RAW_TABLES

LOAD_TIME_COLUMN = "_dbt_loaded_at"  # fixed value: name of the load timestamp in the marts


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    bucket_column: str | None = None,
    buckets: int | None = None,
    path: str | None = None,
) -> None:
    """Save as a Parquet table.

    Tables bucketed and sorted by the same column into the same number of buckets join and
    aggregate on it without a shuffle. One task writes one bucket, so bucket only by a column
    whose values are even; leave a table plain if one value may dominate it.
    """
    if bucket_column:
        df = df.repartition(buckets, bucket_column)
    writer = df.write.format("parquet").mode(mode)
    if path:
        writer = writer.option("path", path)
    if bucket_column:
        writer = writer.bucketBy(buckets, bucket_column).sortBy(bucket_column)
    writer.saveAsTable(name)


def replace_tables(spark: SparkSession, replacements: Mapping[str, str]) -> None:
    """Give each saved table in `replacements` (table -> the one that takes its place) its new name.

    All names are of tables in one database, as "database.table". The former table goes only once
    the new one has its name; until then it is there, if need be under the name that ends in `_old`.
    """
    for table, new in replacements.items():
        old = f"{new}_old"
        known = spark.catalog.tableExists(table)
        if known:
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        if known:
            spark.sql(f"DROP TABLE {old}")


def with_load_time(df: DataFrame, column: str = LOAD_TIME_COLUMN) -> DataFrame:
    """Stamp rows with the time of the query that writes them."""
    return df.withColumn(column, F.current_timestamp())


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make frames available to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def read_raw_tables(spark: SparkSession, database: str = "main") -> dict[str, DataFrame]:
    """Whole raw tables of a database, for those that were loaded."""
    return {
        table: spark.table(f"{database}.{table}")
        for table in RAW_TABLES
        if spark.catalog.tableExists(f"{database}.{table}")
    }


def list_databases(spark: SparkSession) -> DataFrame:
    rows = [(d.name,) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "database string")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of one database, or of all of them."""
    names = [database] if database else [d.name for d in spark.catalog.listDatabases()]
    rows = sorted({
        (".".join(t.namespace or []), t.name, t.tableType)
        for name in names
        for t in spark.catalog.listTables(name)
    })
    return spark.createDataFrame(rows, "database string, table_name string, table_type string")


def describe_table(df: DataFrame) -> DataFrame:
    """Name, type and nullability of each column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, nullable boolean"
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return stacked(counts)


def head_rows(df: DataFrame, n: int = 100) -> DataFrame:
    """Some n rows, without a sort."""
    return df.limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n random rows, or all of them when there are no more than n.

    Rows pass a draw that lets a few more than n through before the n with the smallest numbers
    are taken, so tasks send on little more than n rows together. In the rare case that too few
    pass, all rows come into question.
    """
    drawn = df.withColumn("draw_", F.rand(seed))
    wanted = F.lit(float(n + 10 * math.sqrt(n) + 10))
    limit = df.agg((wanted / F.count(F.lit(1))).alias("share")).scalar()
    enough = drawn.agg((F.count_if(F.col("draw_") < limit) >= n).alias("enough")).scalar()
    passed = drawn.filter((F.col("draw_") < limit) | ~enough)
    return passed.orderBy("draw_").limit(n).drop("draw_")
