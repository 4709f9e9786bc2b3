"""Staging frames: raw headers to snake_case names, one row in for one row out.

Claims and complaints without a description are dropped here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from quaestor.schemas import staging_columns

# Tables whose rows count only if they carry a description.
REQUIRED_DESCRIPTION = {"sinistri": "sinistro", "reclami": "reclami_e_info"}


def stage(table: str, raw: DataFrame) -> DataFrame:
    """Staging frame of one raw table."""
    staged = raw.selectExpr(*[f"`{c.header}` AS {c.staging}" for c in staging_columns(table)])
    described_by = REQUIRED_DESCRIPTION.get(table)
    return staged.filter(F.col(described_by).isNotNull()) if described_by else staged


def stg_clienti(raw: DataFrame) -> DataFrame:
    return stage("clienti", raw)


def stg_polizze(raw: DataFrame) -> DataFrame:
    return stage("polizze", raw)


def stg_sinistri(raw: DataFrame) -> DataFrame:
    return stage("sinistri", raw)


def stg_reclami(raw: DataFrame) -> DataFrame:
    return stage("reclami", raw)


def stg_abitazioni(raw: DataFrame) -> DataFrame:
    return stage("abitazioni", raw)


def stg_interazioni_clienti(raw: DataFrame) -> DataFrame:
    return stage("interazioni_clienti", raw)


def stg_competitor_prodotti(raw: DataFrame) -> DataFrame:
    return stage("competitor_prodotti", raw)


def stage_all(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """`stg_*` frames for every raw table that was loaded."""
    return {f"stg_{table}": stage(table, df) for table, df in raw.items()}
