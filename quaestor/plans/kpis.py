"""Key figures of the report pages, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quaestor.functions.expressions import total
from quaestor.plans.models import ACTIVE


def kpi_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg("clv").alias("avg_clv"),
        F.avg("engagement_score").alias("avg_engagement"),
        F.avg("churn_probability").alias("avg_churn_risk"),
        F.avg("age").alias("avg_age"),
        F.avg("income").alias("avg_income"),
        F.avg("policy_count").alias("avg_policies"),
    )


def kpi_policies(policies: DataFrame) -> DataFrame:
    return policies.agg(
        F.count(F.lit(1)).alias("total_policies"),
        F.count_if(F.col("policy_status") == ACTIVE).alias("active_policies"),
        total("annual_premium").alias("total_premium"),
        F.avg("annual_premium").alias("avg_premium"),
    )


def kpi_value(value_metrics: DataFrame) -> DataFrame:
    return value_metrics.agg(
        F.avg("clv").alias("avg_clv"),
        F.avg("engagement_score").alias("avg_engagement"),
        F.avg("churn_probability").alias("avg_churn_risk"),
    )


def kpi_geography(geography: DataFrame) -> DataFrame:
    return geography.agg(
        F.count_distinct("city").alias("cities"),
        total("clv").alias("total_clv"),
        F.avg("clv").alias("avg_clv"),
    )


def kpi_products(product_performance: DataFrame) -> DataFrame:
    return product_performance.agg(
        F.count_distinct("product").alias("products"),
        total("total_premium").alias("total_revenue"),
        total("total_margin").alias("total_margin"),
    )


def kpi_lifecycle(customers: DataFrame) -> DataFrame:
    tenure = F.col("tenure_years")
    return customers.agg(
        F.avg(tenure).alias("avg_tenure"),
        F.count_if(tenure < 2).alias("new_customers"),
        F.count_if(tenure >= 10).alias("loyal_customers"),
        F.avg("annual_visits").alias("avg_annual_visits"),
    )


def kpi_channels(channel_performance: DataFrame, interaction_summary: DataFrame) -> DataFrame:
    """The conversion rate is the plain mean of the rates of the interaction types."""
    rate = interaction_summary.agg(F.avg("conversion_rate").alias("rate")).scalar()
    return channel_performance.agg(
        F.count(F.lit(1)).alias("channels"), total("total_revenue").alias("total_revenue")
    ).withColumn("avg_conversion_rate", rate)


def kpi_clusters(cluster_summary: DataFrame) -> DataFrame:
    """Largest cluster and cluster of highest value; ties go to the first by name."""

    def first_with_largest(metric: str) -> Column:
        known = F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), "cluster"))
        return F.min_by("cluster", known)

    return cluster_summary.agg(
        F.count(F.lit(1)).alias("clusters"),
        first_with_largest("customer_count").alias("largest_cluster"),
        first_with_largest("avg_clv").alias("highest_clv_cluster"),
    )
