"""Pieces that keep a dominant group from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quaestor.functions.frames import with_known

SALTS = 256


def known_values(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """`groups` and the value as double `v`, where all are known; NaN counts as unknown."""
    values = with_known(df, *groups, value).select(*groups, F.col(value).cast("double").alias("v"))
    return values.filter(~F.isnan("v"))


def weighted_values(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct known values `v` per group with the number of rows `w` that hold each.

    Copies collapse before the shuffle, and a group spreads over tasks by its values.
    """
    known = known_values(df, value, groups)
    return known.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("w"))


def with_group_facts(
    rows: DataFrame, facts: DataFrame, groups: Sequence[str], spread_by: str
) -> DataFrame:
    """`rows` with the one row of `facts` of their group.

    The rows of a group are dealt into `SALTS` parts by a hash of `spread_by`, and the facts are
    repeated for each part. `spread_by` should be distinct within a group.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("salt", parts), [*groups, "salt"]).drop("salt")
