"""Typed load of the delivered CSV files into tables."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quaestor.schemas import RAW_TABLES, raw_schema
from quaestor.sources.tables import save_table

log = logging.getLogger(__name__)


def read_csv_table(
    spark: SparkSession, table: str, path: str, multi_line: bool = False
) -> DataFrame:
    """One raw table from CSV.

    The header must name the schema's columns and a value that does not parse stops the load:
    nothing is silently turned into NULL. `multi_line` reads quoted line breaks, at the price
    of files that cannot be split over tasks.
    """
    return (
        spark.read.schema(raw_schema(table))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def load_csv_tables(
    spark: SparkSession,
    folder: str,
    database: str = "main",
    replace: bool = True,
    tables: Iterable[str] = tuple(RAW_TABLES),
    bucket_column: str | None = None,
    buckets: int | None = None,
    multi_line: bool = False,
) -> list[str]:
    """Load `<folder>/<table>.csv` into `database`, and return the tables whose file was there.

    `replace` recreates a table, otherwise an existing one is kept as it is. A file that is not
    there is warned about and skipped.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    loaded = []
    for table in tables:
        path = f"{folder.rstrip('/')}/{table}.csv"
        try:
            df = read_csv_table(spark, table, path, multi_line)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition() or ""):
                raise
            log.warning("no file for table %s at %s; skipped", table, path)
            continue
        keyed = bucket_column in df.columns
        save_table(
            df, f"{database}.{table}", "overwrite" if replace else "ignore",
            bucket_column=bucket_column if keyed else None, buckets=buckets if keyed else None,
        )
        loaded.append(table)
    return loaded
