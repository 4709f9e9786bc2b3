"""Queries through files, tables and views: what is loaded or saved is read back.

Each run has a database of its own below the folder all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaestor.functions.frames import stacked
from quaestor.operators.extracts import CustomerFilter
from quaestor.plans.pipeline import run_pipeline
from quaestor.plans.report import report
from quaestor.sources.csv_tables import load_csv_tables
from quaestor.sources.tables import (
    LOAD_TIME_COLUMN, describe_table, list_databases, list_tables, read_raw_tables, register_views, row_counts,
)


class Store:
    """An empty folder and a database in it, with one for marts beside it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            shared = tempfile.mkdtemp(prefix="store-")
        self.database = f"store_{uuid.uuid4().hex[:12]}"
        self.folder = f"{shared.rstrip('/')}/{self.database}"
        for name in (self.database, f"{self.database}_marts"):
            spark.sql(f"CREATE DATABASE {name} LOCATION '{self.folder}/{name}'")

    def delivered(self, tables: Mapping[str, DataFrame], delivery: str) -> str:
        """The folder of a delivery: a compressed CSV with header per table."""
        for name, df in tables.items():
            df.write.csv(f"{self.folder}/{delivery}/{name}.csv", header=True, escape='"', compression="snappy")
        return f"{self.folder}/{delivery}"


def csv_load(spark: SparkSession, raw: Mapping[str, DataFrame], table: str) -> DataFrame:
    """A table after it was loaded from CSV in place of an empty one."""
    store = Store(spark)
    for delivery, df in (("empty", raw[table].limit(0)), ("whole", raw[table])):
        load_csv_tables(spark, store.delivered({table: df}, delivery), store.database, tables=[table])
    return read_raw_tables(spark, store.database)[table]


def csv_load_counts(spark: SparkSession, raw: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table after a load of all of them that keeps what an earlier one left."""
    store = Store(spark)
    kept = ["clienti", "sinistri"]
    load_csv_tables(spark, store.delivered(raw, "whole"), store.database, tables=kept)
    nothing = {table: raw[table].limit(0) for table in kept}
    rest = {table: df for table, df in raw.items() if table not in kept}
    load_csv_tables(spark, store.delivered({**nothing, **rest}, "later"), store.database, replace=False)
    return row_counts(read_raw_tables(spark, store.database))


def catalogue(spark: SparkSession, raw: Mapping[str, DataFrame]) -> DataFrame:
    """The tables of a database they were loaded into, and whether the database is listed."""
    store = Store(spark)
    load_csv_tables(spark, store.delivered(raw, "whole"), store.database)
    known = list_databases(spark).filter(F.col("database") == store.database)
    listed = list_tables(spark, store.database).filter(F.col("database") == store.database)
    # At most one row to broadcast.
    return listed.join(F.broadcast(known), "database").select("table_name", "table_type")


def described(spark: SparkSession, raw: Mapping[str, DataFrame]) -> DataFrame:
    """Columns, types and nullability of the loaded tables."""
    store = Store(spark)
    load_csv_tables(spark, store.delivered(raw, "whole"), store.database)
    return stacked([
        describe_table(df).select(F.lit(table).alias("table_name"), "*")
        for table, df in read_raw_tables(spark, store.database).items()
    ])


def saved_mart(spark: SparkSession, raw: Mapping[str, DataFrame], company: str, as_of: str, mart: str) -> DataFrame:
    """A mart as the pipeline saved it."""
    store = Store(spark)
    run_pipeline(spark, raw, company, store.database, as_of)
    return spark.table(f"{store.database}_marts.{mart}").drop(LOAD_TIME_COLUMN)


def through_views(spark: SparkSession, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A frame read from the view that stands for it in SQL."""
    view = f"{name}_{uuid.uuid4().hex[:12]}"
    register_views({view: frames[name]})
    return spark.sql(f"SELECT * FROM {view}")


def report_page(staged: Mapping[str, DataFrame], where: CustomerFilter, page: str) -> DataFrame:
    """A page of the report. The selection it shares with others is cached while they are built."""
    with report(staged, where) as pages:
        return pages[page]
