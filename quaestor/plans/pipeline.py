"""Raw tables to staging, customer aggregates, saved marts and the check report."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from quaestor.operators.checks import Check, check_report
from quaestor.operators.staging import stage_all
from quaestor.plans import models
from quaestor.plans.check_definitions import CHECKS
from quaestor.plans.models import AsOf
from quaestor.schemas import CUSTOMER_KEY
from quaestor.sources.tables import register_views, replace_tables, save_table, with_load_time

INTERMEDIATE = ("int_customer_policies", "int_customer_claims", "int_customer_interactions")
MARTS = ("dim_customers", "fact_policies", "mart_competitor_analysis")


def build_frames(
    raw: Mapping[str, DataFrame], company: str, as_of: AsOf = None
) -> dict[str, DataFrame]:
    """Every staging, intermediate and mart frame over the raw tables; nothing runs yet."""
    frames = stage_all(raw)
    clienti, polizze = frames["stg_clienti"], frames["stg_polizze"]
    frames["int_customer_policies"] = models.int_customer_policies(clienti, polizze)
    frames["int_customer_claims"] = models.int_customer_claims(frames["stg_sinistri"], as_of)
    frames["int_customer_interactions"] = models.int_customer_interactions(
        frames["stg_interazioni_clienti"]
    )
    frames["dim_customers"] = models.dim_customers(
        frames["int_customer_policies"],
        frames["int_customer_interactions"],
        frames["int_customer_claims"],
    )
    frames["fact_policies"] = models.fact_policies(polizze, clienti, as_of)
    frames["mart_competitor_analysis"] = models.mart_competitor_analysis(
        polizze, frames["stg_competitor_prodotti"], company
    )
    return frames


def run_pipeline(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    company: str,
    database: str = "main",
    as_of: AsOf = None,
    checks: Sequence[Check] = tuple(CHECKS),
    customer_buckets: int | None = None,
    only_if_passing: bool = False,
) -> DataFrame:
    """Register views, replace the mart tables in `<database>_marts` and return the check report.

    New marts are saved under names of this run, checked as they were saved, and only then take
    the place of the former ones, so readers see whole and checked marts. With `only_if_passing`
    they don't if a check fails: the former marts stay and the new ones are dropped. The report is
    saved either way. What a run that breaks off has saved stays under its own names.

    Staging and intermediate frames become temporary views; the competitor mart keeps no load
    time. The customer dimension holds a customer once, so it can be bucketed by customer. The
    customer aggregates are needed by a mart and by the checks, so they are cached for the run; the
    report is small and complete when this returns.
    """
    frames = build_frames(raw, company, as_of)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}_marts`")
    cached = [frames[name].persist() for name in INTERMEDIATE]
    run = uuid.uuid4().hex[:12]
    staged = {f"{database}_marts.{mart}": f"{database}_marts.{mart}_{run}" for mart in MARTS}
    try:
        register_views({n: f for n, f in frames.items() if n not in MARTS})
        saved = {}
        for mart, table in zip(MARTS, staged.values(), strict=True):
            stamped = mart != "mart_competitor_analysis"
            bucketed = customer_buckets if mart == "dim_customers" else None
            save_table(
                with_load_time(frames[mart]) if stamped else frames[mart],
                table,
                bucket_column=CUSTOMER_KEY if bucketed else None,
                buckets=bucketed,
            )
            saved[mart] = spark.table(table)
        save_table(check_report({**raw, **frames, **saved}, checks), f"{database}_marts.check_report")
    finally:
        for frame in cached:
            frame.unpersist()
    report = spark.table(f"{database}_marts.check_report")
    if only_if_passing and not report.filter("status = 'fail'").isEmpty():
        for table in staged.values():
            spark.sql(f"DROP TABLE {table}")
    else:
        replace_tables(spark, staged)
    return report
