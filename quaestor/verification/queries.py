"""Every operator as a query over a folder of source tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaestor.functions.expressions import round_to
from quaestor.functions.frames import stacked, with_known
from quaestor.operators import checks, distributions, extracts, profile
from quaestor.operators.extracts import CustomerFilter
from quaestor.operators.staging import stage, stage_all
from quaestor.plans import analyses, kpis, models
from quaestor.plans.check_definitions import CHECKS
from quaestor.plans.pipeline import build_frames
from quaestor.schemas import RAW_TABLES
from quaestor.sources.binding import raw_table, raw_tables
from quaestor.sources.tables import describe_table, head_rows, row_counts, sample_rows
from quaestor.verification import stores
from quaestor.verification.views import AS_OF, COMPANY, EARLY

Query = Callable[[SparkSession, str], DataFrame]

SELECTION = CustomerFilter(age=(25, 70), income=(0, 8000), cluster="High_Responder")
MAP_POINTS = 7000
CLAIMS = "int_customer_claims"


class Inputs:
    """Frames over one folder, each built when a query first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def stage(self, table: str) -> DataFrame:
        return stage(table, raw_table(self.spark, self.folder, table))

    @cached_property
    def clienti(self) -> DataFrame:
        return self.stage("clienti")

    @cached_property
    def polizze(self) -> DataFrame:
        return self.stage("polizze")

    @cached_property
    def sinistri(self) -> DataFrame:
        return self.stage("sinistri")

    @cached_property
    def reclami(self) -> DataFrame:
        return self.stage("reclami")

    @cached_property
    def abitazioni(self) -> DataFrame:
        return self.stage("abitazioni")

    @cached_property
    def interazioni(self) -> DataFrame:
        return self.stage("interazioni_clienti")

    @cached_property
    def competitors(self) -> DataFrame:
        return self.stage("competitor_prodotti")

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return raw_tables(self.spark, self.folder)

    @cached_property
    def staged(self) -> dict[str, DataFrame]:
        return stage_all(self.raw)

    @cached_property
    def all_tables(self) -> dict[str, DataFrame]:
        return {**self.raw, **build_frames(self.raw, COMPANY, AS_OF)}

    @cached_property
    def customer_policies(self) -> DataFrame:
        return models.int_customer_policies(self.clienti, self.polizze)

    @cached_property
    def customer_claims(self) -> DataFrame:
        return models.int_customer_claims(self.sinistri, AS_OF)

    @cached_property
    def customer_interactions(self) -> DataFrame:
        return models.int_customer_interactions(self.interazioni)

    @cached_property
    def everyone(self) -> DataFrame:
        return extracts.customer_demographics(self.clienti)

    @cached_property
    def selected(self) -> DataFrame:
        return extracts.filter_customers(self.everyone, SELECTION)

    @cached_property
    def policies(self) -> DataFrame:
        return extracts.of_customers(extracts.policy_extract(self.polizze), self.selected)

    @cached_property
    def geography(self) -> DataFrame:
        return extracts.of_customers(extracts.customer_geography(self.clienti), self.selected)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round what two engines may sum in a different order."""
    return df.withColumns({c: round_to(F.col(c), digits) for c in columns})


def _rounded_box(df: DataFrame) -> DataFrame:
    return _rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


def _sample_check(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """What must hold of any sample: how many rows, and none that is strange or there twice."""
    known = source.select(key).distinct().withColumn("known", F.lit(True))
    return rows.select(key).join(known, key, "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("known").isNull()).alias("strange"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("doubled"),
    )


def _over_inputs() -> dict[str, Callable[[Inputs], DataFrame]]:
    e, a, k, d, p = extracts, analyses, kpis, distributions, profile
    density = lambda df: _rounded(df, "x", "density", digits=9)
    return {
        # Sources
        "source_row_counts": lambda i: row_counts(i.raw),
        "head_rows": lambda i: head_rows(raw_table(i.spark, i.folder, "clienti")),
        "geo_sample": lambda i: sample_rows(e.customer_geography(i.clienti), MAP_POINTS),
        "head_rows_check": lambda i: _sample_check(
            head_rows(i.stage("clienti")), i.clienti, "codice_cliente"
        ),
        "geo_sample_check": lambda i: _sample_check(
            sample_rows(e.customer_geography(i.clienti), MAP_POINTS),
            e.customer_geography(i.clienti), "customer_id",
        ),
        "describe_tables": lambda i: stacked([
            describe_table(df).select(F.lit(t).alias("table_name"), "column_name", "data_type")
            for t, df in i.raw.items()
        ]),
        # Files, tables and views
        "csv_load_homes": lambda i: stores.csv_load(i.spark, i.raw, "abitazioni"),
        "csv_load_counts": lambda i: stores.csv_load_counts(i.spark, i.raw),
        "catalogue_tables": lambda i: stores.catalogue(i.spark, i.raw),
        "described_tables": lambda i: stores.described(i.spark, i.raw),
        "saved_fact_policies": lambda i: stores.saved_mart(
            i.spark, i.raw, COMPANY, AS_OF, "fact_policies"
        ),
        "saved_check_report": lambda i: stores.saved_mart(
            i.spark, i.raw, COMPANY, AS_OF, "check_report"
        ),
        "view_claims": lambda i: stores.through_views(
            i.spark, {CLAIMS: i.customer_claims}, CLAIMS
        ),
        "report_cities": lambda i: stores.report_page(i.staged, SELECTION, "city_clv"),
        "report_policies": lambda i: stores.report_page(i.staged, SELECTION, "kpi_policies"),
        # Models
        **{f"stg_{t}": lambda i, t=t: i.stage(t) for t in RAW_TABLES},
        "int_customer_policies": lambda i: i.customer_policies,
        "int_customer_claims": lambda i: i.customer_claims,
        "int_customer_interactions": lambda i: i.customer_interactions,
        "dim_customers": lambda i: models.dim_customers(
            i.customer_policies, i.customer_interactions, i.customer_claims
        ),
        "fact_policies": lambda i: models.fact_policies(i.polizze, i.clienti, AS_OF),
        "mart_competitor_analysis": lambda i: models.mart_competitor_analysis(
            i.polizze, i.competitors, COMPANY
        ),
        # Extracts and filters
        "customer_demographics": lambda i: i.everyone,
        "policy_extract": lambda i: e.policy_extract(i.polizze),
        "interaction_extract": lambda i: e.interaction_extract(i.interazioni),
        "customer_geography": lambda i: e.customer_geography(i.clienti),
        "value_extract": lambda i: e.value_extract(i.clienti),
        "claims_extract": lambda i: e.claims_extract(i.sinistri),
        "competitor_extract": lambda i: e.competitor_extract(i.competitors),
        "complaints_extract": lambda i: e.complaints_extract(i.reclami),
        "housing_extract": lambda i: e.housing_extract(i.abitazioni),
        "filtered_customers": lambda i: i.selected,
        "filtered_policies": lambda i: i.policies,
        "filter_ranges": lambda i: e.filter_ranges(i.everyone),
        "cluster_choices": lambda i: e.cluster_choices(i.everyone),
        "customer_value_metrics": lambda i: e.customer_value_metrics(i.selected),
        "lifecycle_stage_sql": lambda i: e.lifecycle_stage_sql(i.clienti),
        "lifecycle_stage_binned": lambda i: e.lifecycle_stage_binned(i.selected),
        "engagement_by_tenure": lambda i: with_known(
            e.lifecycle_stage_binned(i.selected), "engagement_score"
        ),
        # Analyses
        "client_stats": lambda i: a.client_stats(i.clienti),
        "policy_types": lambda i: a.policy_types(i.polizze),
        "claims_by_product_status": lambda i: a.claims_by_product_status(i.sinistri),
        "complaint_types": lambda i: a.complaint_types(i.reclami),
        "complaints_by_product": lambda i: a.complaints_by_product(i.reclami),
        "interactions_by_type_outcome": lambda i: a.interactions_by_type_outcome(i.interazioni),
        "properties_by_city": lambda i: a.properties_by_city(i.abitazioni),
        "competitor_products": lambda i: a.competitor_products(i.competitors),
        "product_performance": lambda i: a.product_performance(i.polizze),
        "top_products_by_premium": lambda i: a.top_products_by_premium(i.polizze),
        "channel_performance": lambda i: a.channel_performance(i.polizze, i.clienti),
        "interaction_summary": lambda i: a.interaction_summary(i.interazioni),
        "cluster_summary": lambda i: _rounded(a.cluster_summary(i.clienti), *a.CLUSTER_AVERAGES),
        "multi_claim_customers": lambda i: a.multi_claim_customers(i.clienti, i.sinistri),
        "policy_trends": lambda i: a.policy_trends(i.polizze, top_n=None),
        "policy_trends_top": lambda i: a.policy_trends(i.polizze),
        "customer_policy_join": lambda i: a.customer_policy_join(i.clienti, i.polizze),
        "monthly_claims": lambda i: a.monthly_claims(i.sinistri),
        "premium_by_need_area": lambda i: a.premium_by(i.policies, "need_area", ascending=True),
        "premium_by_product": lambda i: a.premium_by(i.policies, "product"),
        "premium_by_product_top": lambda i: a.premium_by(i.policies, "product", top_n=3),
        "city_clv": lambda i: a.city_clv(i.geography),
        "market_share_by_competitor": lambda i: a.market_share_by_competitor(i.competitors),
        "cluster_share": lambda i: a.share_of_total(i.everyone, "cluster"),
        "claim_status_share": lambda i: a.share_of_total(e.claims_extract(i.sinistri), "status"),
        "alarm_share": lambda i: a.share_of_total(i.abitazioni, "sistema_allarme"),
        "top_professions": lambda i: a.value_counts(i.selected, "profession", 10),
        "top_claim_products": lambda i: a.value_counts(
            e.claims_extract(i.sinistri), "product", 10
        ),
        "top_complaint_products": lambda i: a.value_counts(i.reclami, "prodotto", 10),
        # Key figures
        "kpi_customers": lambda i: _rounded(k.kpi_customers(i.selected), "avg_churn_risk"),
        "kpi_policies": lambda i: k.kpi_policies(i.policies),
        "kpi_value": lambda i: _rounded(
            k.kpi_value(e.customer_value_metrics(i.selected)), "avg_churn_risk"
        ),
        "kpi_geography": lambda i: k.kpi_geography(i.geography),
        "kpi_products": lambda i: k.kpi_products(a.product_performance(i.polizze)),
        "kpi_lifecycle": lambda i: k.kpi_lifecycle(i.selected),
        "kpi_channels": lambda i: _rounded(
            k.kpi_channels(
                a.channel_performance(i.polizze, i.clienti), a.interaction_summary(i.interazioni)
            ),
            "avg_conversion_rate",
        ),
        "kpi_clusters": lambda i: k.kpi_clusters(a.cluster_summary(i.clienti)),
        # Profiles
        "profile_columns": lambda i: p.profile_columns(i.raw),
        "profile_nulls": lambda i: p.profile_nulls(i.raw),
        "profile_numeric": lambda i: _rounded(
            p.profile_numeric(i.staged), "mean", "std", "q25", "q50", "q75"
        ),
        "profile_numeric_raw": lambda i: _rounded(
            p.profile_numeric(i.raw), "mean", "std", "q25", "q50", "q75"
        ),
        "profile_top_values": lambda i: p.profile_top_values(i.raw),
        "profile_categorical": lambda i: p.profile_categorical(i.raw),
        "profile_dates": lambda i: p.profile_dates(i.raw),
        "profile_histograms": lambda i: p.profile_histograms(i.raw, 30),
        "profile_duplicates_raw": lambda i: p.profile_duplicates(i.raw),
        "profile_overview_raw": lambda i: p.profile_overview(i.raw),
        "profile_duplicates": lambda i: p.profile_duplicates(i.staged),
        "profile_overview": lambda i: p.profile_overview(i.staged),
        # Distributions
        "hist_age": lambda i: d.histogram(i.everyone, "age", 30),
        "hist_income": lambda i: d.histogram(i.everyone, "income", 30),
        "hist_clv": lambda i: d.histogram(i.everyone, "clv", 50),
        "hist_tenure": lambda i: d.histogram(e.lifecycle_stage_sql(i.clienti), "tenure_years", 20),
        "hist_property_size": lambda i: d.histogram(i.abitazioni, "metratura", 30),
        "hist_claim_amount_log": lambda i: _rounded(
            d.log_histogram(e.claims_extract(i.sinistri), "claim_amount", 50),
            "bin_start", "bin_end",
        ),
        "box_premium_by_area": lambda i: _rounded_box(
            d.box_summary(e.policy_extract(i.polizze), "annual_premium", "need_area", few_groups=True)
        ),
        "box_clv_by_cluster": lambda i: _rounded_box(
            d.box_summary(e.value_extract(i.clienti), "clv", "cluster", few_groups=True)
        ),
        "box_churn_by_stage": lambda i: _rounded_box(
            d.box_summary(
                e.lifecycle_stage_sql(i.clienti), "churn_probability", "lifecycle_stage",
                few_groups=True,
            )
        ),
        "density_age": lambda i: density(d.density_curve(i.everyone, "age")),
        "density_income": lambda i: density(d.density_curve(i.everyone, "income")),
        "density_tenure": lambda i: density(
            d.density_curve(e.lifecycle_stage_sql(i.clienti), "tenure_years")
        ),
        "density_property_size": lambda i: density(d.density_curve(i.abitazioni, "metratura")),
        "density_visits_by_stage": lambda i: density(
            d.density_curve(
                e.lifecycle_stage_sql(i.clienti), "annual_visits", ["lifecycle_stage"],
                points=100, reach=2.0,
            )
        ),
        # Data checks
        "dq_row_checks": lambda i: checks.row_checks(i.all_tables, CHECKS),
        "dq_unique": lambda i: checks.unique_checks(i.all_tables, CHECKS),
        "dq_relationships": lambda i: checks.relationship_checks(i.all_tables, CHECKS),
        "dq_accepted_values": lambda i: checks.value_checks(i.all_tables, CHECKS),
        "dq_claims_early": lambda i: checks.row_checks(
            {CLAIMS: models.int_customer_claims(i.sinistri, EARLY)},
            [c for c in CHECKS if c.table == CLAIMS],
        ),
        "dq_report": lambda i: checks.check_report(i.all_tables, CHECKS),
    }


def queries() -> dict[str, Query]:
    return {
        name: lambda spark, folder, run=run: run(Inputs(spark, folder))
        for name, run in _over_inputs().items()
    }
