"""Portfolio, claims, channel, cluster and market analyses over staging frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaestor.functions.expressions import ratio, round_to, total
from quaestor.operators.extracts import claims_extract
from quaestor.plans.models import ACTIVE
from quaestor.schemas import CUSTOMER_KEY
# The averages of a cluster profile.
CLUSTER_AVERAGES = {
    "avg_age": "eta", "avg_income": "reddito", "avg_policies": "num_polizze",
    "avg_clv": "clv_stimato", "avg_engagement": "engagement_score",
    "avg_churn_risk": "churn_probability", "avg_satisfaction": "satisfaction_score",
}


def _n() -> Column:
    return F.count(F.lit(1))


def _flagged(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def value_counts(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Known values by how often they occur; equal counts go by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(_n().alias("n"))
    ranked = counts.orderBy(F.desc("n"), F.asc(column))
    return ranked if top_n is None else ranked.limit(top_n)


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Known values with their count and their share of all in percent."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(_n().alias("n"))
    everything = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("pct", ratio(F.col("n"), everything) * 100)


def client_stats(clienti: DataFrame) -> DataFrame:
    return clienti.agg(
        _n().alias("total_clients"),
        F.count_distinct(CUSTOMER_KEY).alias("unique_clients"),
    )


def policy_types(polizze: DataFrame) -> DataFrame:
    return (
        polizze.groupBy("prodotto", "area_bisogno")
        .agg(
            _n().alias("count"),
            round_to(F.avg("premio_totale_annuo"), 2).alias("avg_annual_premium"),
            round_to(F.avg("massimale"), 2).alias("avg_insured_value"),
        )
        .orderBy(F.desc("count"))
    )


def claims_by_product_status(sinistri: DataFrame) -> DataFrame:
    return (
        sinistri.groupBy("prodotto", "area_bisogno", "stato_liquidazione")
        .agg(
            _n().alias("count"),
            round_to(F.avg("importo_liquidato"), 2).alias("avg_paid"),
        )
        .orderBy(F.asc_nulls_last("prodotto"), F.asc_nulls_last("area_bisogno"))
    )


def complaint_types(reclami: DataFrame) -> DataFrame:
    return (
        reclami.select("prodotto", "area_bisogno", "reclami_e_info")
        .distinct()
        .orderBy(F.asc_nulls_last("area_bisogno"))
    )


def complaints_by_product(reclami: DataFrame) -> DataFrame:
    return (
        reclami.groupBy("prodotto", "area_bisogno")
        .agg(_n().alias("count"), F.count_distinct(CUSTOMER_KEY).alias("unique_clients"))
        .orderBy(F.desc("count"))
    )


def interactions_by_type_outcome(interazioni: DataFrame) -> DataFrame:
    return (
        interazioni.groupBy("tipo_interazione", "esito")
        .agg(
            _n().alias("count"),
            round_to(F.avg("durata_minuti"), 1).alias("avg_duration_minutes"),
            _flagged(F.col("conversione")).alias("conversions"),
        )
        .orderBy(F.desc_nulls_last("esito"), F.asc_nulls_last("tipo_interazione"))
    )


def properties_by_city(abitazioni: DataFrame) -> DataFrame:
    return (
        abitazioni.groupBy("luogo_residenza")
        .agg(
            _n().alias("count"),
            round_to(F.avg("metratura"), 1).alias("avg_square_meters"),
            _flagged(F.col("sistema_allarme")).alias("with_alarm"),
        )
        .orderBy(F.desc("count"))
    )


def competitor_products(competitors: DataFrame) -> DataFrame:
    return (
        competitors.groupBy("competitor", "tipo_prodotto")
        .agg(
            round_to(F.avg("premio_medio"), 2).alias("avg_premium"),
            round_to(F.avg("massimale_medio"), 2).alias("avg_coverage"),
            round_to(F.avg("rating_clienti"), 2).alias("avg_rating"),
        )
        .orderBy(F.asc_nulls_last("competitor"), F.asc_nulls_last("tipo_prodotto"))
    )


def product_performance(polizze: DataFrame) -> DataFrame:
    """Loss ratio, premium and margin of the active policies by product and need area."""
    return (
        polizze.filter(F.col("stato_polizza") == ACTIVE)
        .groupBy(F.col("prodotto").alias("product"), F.col("area_bisogno").alias("need_area"))
        .agg(
            F.avg("loss_ratio").alias("avg_loss_ratio"),
            F.sum("premio_totale_annuo").alias("total_premium"),
            F.sum("margine_lordo").alias("total_margin"),
            _n().alias("policy_count"),
            F.avg("premio_totale_annuo").alias("avg_premium"),
        )
        .orderBy(F.desc_nulls_last("total_premium"), "product", "need_area")
    )


def top_products_by_premium(polizze: DataFrame, top_n: int = 10) -> DataFrame:
    """The products of `product_performance` with the largest known premium."""
    return (
        product_performance(polizze)
        .filter(F.col("total_premium").isNotNull())
        .orderBy(F.desc("total_premium"), F.asc_nulls_last("product"), F.asc_nulls_last("need_area"))
        .limit(top_n)
    )


def channel_performance(polizze: DataFrame, clienti: DataFrame) -> DataFrame:
    """Customers, customer value and revenue of the active policies by acquisition channel.

    Customer averages are weighted by policies. Both sides are reduced to sums per customer
    before the join, so the join moves one row per customer and channel however many policies
    a customer holds.
    """
    sold = (
        polizze.filter((F.col("stato_polizza") == ACTIVE) & F.col(CUSTOMER_KEY).isNotNull())
        .groupBy(CUSTOMER_KEY, F.col("canale_acquisizione").alias("channel"))
        .agg(
            _n().alias("policies"),
            F.sum("premio_totale_annuo").alias("premium"),
            F.count("premio_totale_annuo").alias("premiums"),
            F.sum("margine_lordo").alias("margin"),
        )
    )
    owners = clienti.groupBy(CUSTOMER_KEY).agg(
        _n().alias("copies"),
        F.sum("clv_stimato").alias("clv"),
        F.count("clv_stimato").alias("clvs"),
        F.sum("engagement_score").alias("engagement"),
        F.count("engagement_score").alias("engagements"),
    )
    policies, copies = F.col("policies"), F.col("copies")
    return (
        sold.join(owners, CUSTOMER_KEY)
        .groupBy("channel")
        .agg(
            _n().alias("customer_count"),
            ratio(F.sum(policies * F.col("clv")), F.sum(policies * F.col("clvs"))).alias("avg_clv"),
            ratio(
                F.sum(policies * F.col("engagement")), F.sum(policies * F.col("engagements"))
            ).alias("avg_engagement"),
            ratio(F.sum(copies * F.col("premium")), F.sum(copies * F.col("premiums"))).alias(
                "avg_premium"
            ),
            F.sum(copies * F.col("premium")).alias("total_revenue"),
            F.sum(copies * F.col("margin")).alias("total_margin"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"))
    )


def interaction_summary(interazioni: DataFrame) -> DataFrame:
    return (
        interazioni.groupBy(F.col("tipo_interazione").alias("interaction_type"))
        .agg(
            _n().alias("interaction_count"),
            F.avg("durata_minuti").alias("avg_duration"),
            (ratio(_flagged(F.col("conversione")), _n()) * 100).alias("conversion_rate"),
        )
        .orderBy(F.desc("interaction_count"))
    )


def cluster_summary(clienti: DataFrame) -> DataFrame:
    return (
        clienti.filter(F.col("cluster_risposta").isNotNull())
        .groupBy(F.col("cluster_risposta").alias("cluster"))
        .agg(
            _n().alias("customer_count"),
            *[F.avg(column).alias(name) for name, column in CLUSTER_AVERAGES.items()],
        )
        .orderBy("cluster")
    )


def multi_claim_customers(
    clienti: DataFrame, sinistri: DataFrame, top_n: int | None = 10
) -> DataFrame:
    """Customers with more than one described claim, most claims first; ties by customer."""
    per_customer = sinistri.groupBy(CUSTOMER_KEY).agg(
        F.count("sinistro").alias("claims"), F.sum("importo_liquidato").alias("paid")
    )
    names = clienti.groupBy(CUSTOMER_KEY, "nome", "cognome").agg(_n().alias("copies"))
    copies = F.col("copies")
    ranked = (
        names.join(per_customer, CUSTOMER_KEY)
        .select(
            CUSTOMER_KEY, "nome", "cognome",
            (copies * F.col("claims")).alias("total_claims"),
            (copies * F.col("paid")).cast("double").alias("total_paid"),
        )
        .filter(F.col("total_claims") > 1)
        .orderBy(F.desc("total_claims"), CUSTOMER_KEY, "nome", "cognome")
    )
    return ranked if top_n is None else ranked.limit(top_n)


def policy_trends(polizze: DataFrame, top_n: int | None = 20) -> DataFrame:
    """Policies started per product and day, with the running total of the product.

    The window runs over days, not policies.
    """
    daily = polizze.groupBy("data_emissione", "prodotto").agg(_n().alias("policies_started"))
    to_date = (
        Window.partitionBy("prodotto")
        .orderBy(F.asc_nulls_last("data_emissione"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = daily.withColumn(
        "cumulative_policies", F.sum("policies_started").over(to_date)
    ).orderBy(F.asc_nulls_last("prodotto"), F.asc_nulls_last("data_emissione"))
    return ordered if top_n is None else ordered.limit(top_n)


def customer_policy_join(clienti: DataFrame, polizze: DataFrame) -> DataFrame:
    """One row per policy of a known customer."""
    return clienti.select(CUSTOMER_KEY, "nome", "cognome").join(
        polizze.select(
            CUSTOMER_KEY, "prodotto", "area_bisogno", "premio_totale_annuo",
            "data_emissione", "data_scadenza",
        ),
        CUSTOMER_KEY,
    )


def monthly_claims(sinistri: DataFrame) -> DataFrame:
    """Claims per calendar month from the first to the last, empty months included."""
    months = claims_extract(sinistri).select(F.trunc("claim_date", "month").alias("month_start"))
    counts = months.groupBy("month_start").agg(_n().alias("claims"))
    spine = counts.agg(
        F.min("month_start").alias("first"), F.max("month_start").alias("last")
    ).select(F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("month_start"))
    return (
        spine.join(counts, "month_start", "left")
        .select(
            F.last_day("month_start").alias("month_end"),
            F.coalesce("claims", F.lit(0)).alias("claims"),
        )
        .orderBy("month_end")
    )


def premium_by(
    policies: DataFrame, column: str, ascending: bool = False, top_n: int | None = None
) -> DataFrame:
    """Total annual premium by a column of the policy extract; unknown values are left out."""
    totals = (
        policies.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(total("annual_premium").alias("total_premium"))
    )
    order = F.asc("total_premium") if ascending else F.desc("total_premium")
    ordered = totals.orderBy(order, column)
    return ordered if top_n is None else ordered.limit(top_n)


def city_clv(geography: DataFrame, top_n: int = 15) -> DataFrame:
    """Cities by the summed value of their customers."""
    return (
        geography.filter(F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            total("clv").alias("total_clv"),
            F.count("clv").alias("customer_count"),
            F.avg("clv").alias("avg_clv"),
        )
        .orderBy(F.desc("total_clv"), "city")
        .limit(top_n)
    )


def market_share_by_competitor(competitors: DataFrame) -> DataFrame:
    return (
        competitors.filter(F.col("competitor").isNotNull())
        .groupBy("competitor")
        .agg(total("quota_mercato_perc").alias("market_share"))
        .orderBy(F.desc("market_share"), "competitor")
    )
