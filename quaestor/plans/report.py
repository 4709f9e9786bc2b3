"""The frames behind the report pages, for one selection of customers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame

from quaestor.functions.frames import with_known
from quaestor.operators import distributions, extracts
from quaestor.operators.extracts import CustomerFilter
from quaestor.plans import analyses, kpis
from quaestor.sources.tables import sample_rows

MAP_POINTS = 5000  # fixed value: points a map page shows at most


@contextmanager
def report(
    staged: Mapping[str, DataFrame], where: CustomerFilter = CustomerFilter()
) -> Iterator[dict[str, DataFrame]]:
    """Frames by name. The selected customers stay cached while the block runs.

    Pages on customers, policies and geography follow the selection; products, channels and
    clusters always cover the whole portfolio.
    """
    clienti, polizze = staged["stg_clienti"], staged["stg_polizze"]
    everyone = extracts.customer_demographics(clienti)
    customers = extracts.filter_customers(everyone, where).persist()
    try:
        policies = extracts.of_customers(extracts.policy_extract(polizze), customers)
        geography = extracts.of_customers(extracts.customer_geography(clienti), customers)
        value = extracts.customer_value_metrics(customers)
        lifecycle = extracts.lifecycle_stage_binned(customers)
        products = analyses.product_performance(polizze)
        channels = analyses.channel_performance(polizze, clienti)
        interactions = analyses.interaction_summary(staged["stg_interazioni_clienti"])
        clusters = analyses.cluster_summary(clienti)
        yield {
            "filter_ranges": extracts.filter_ranges(everyone),
            "cluster_choices": extracts.cluster_choices(everyone),
            "kpi_customers": kpis.kpi_customers(customers),
            "hist_age": distributions.histogram(customers, "age", 30),
            "hist_income": distributions.histogram(customers, "income", 30),
            "top_professions": analyses.value_counts(customers, "profession", 10),
            "kpi_policies": kpis.kpi_policies(policies),
            "premium_by_need_area": analyses.premium_by(policies, "need_area", ascending=True),
            "premium_by_product": analyses.premium_by(policies, "product", top_n=10),
            "box_premium_by_area": distributions.box_summary(
                policies, "annual_premium", "need_area", few_groups=True
            ),
            "customer_value_metrics": value,
            "kpi_value": kpis.kpi_value(value),
            "box_clv_by_cluster": distributions.box_summary(
                value, "clv", "cluster", few_groups=True
            ),
            "hist_clv": distributions.histogram(value, "clv", 50),
            "kpi_geography": kpis.kpi_geography(geography),
            "geo_sample": sample_rows(geography, MAP_POINTS),
            "city_clv": analyses.city_clv(geography),
            "kpi_products": kpis.kpi_products(products),
            "product_performance": products.limit(20),
            "top_products_by_premium": analyses.top_products_by_premium(polizze),
            "kpi_lifecycle": kpis.kpi_lifecycle(customers),
            "hist_tenure": distributions.histogram(customers, "tenure_years", 20),
            "box_churn_by_stage": distributions.box_summary(
                lifecycle, "churn_probability", "lifecycle_stage", few_groups=True
            ),
            "engagement_by_tenure": with_known(lifecycle, "engagement_score"),
            "kpi_channels": kpis.kpi_channels(channels, interactions),
            "channel_performance": channels,
            "interaction_summary": interactions,
            "kpi_clusters": kpis.kpi_clusters(clusters),
            "cluster_summary": clusters,
            "cluster_share": analyses.share_of_total(everyone, "cluster"),
        }
    finally:
        customers.unpersist()
