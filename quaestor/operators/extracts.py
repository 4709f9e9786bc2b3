"""Column extracts under report names, and the row filters that reports share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quaestor.functions.expressions import ladder
from quaestor.functions.frames import with_known

# Staging column -> report column.
DEMOGRAPHICS = {
    "codice_cliente": "customer_id", "eta": "age", "reddito": "income",
    "professione": "profession", "luogo_residenza": "city", "cluster_risposta": "cluster",
    "engagement_score": "engagement_score", "churn_probability": "churn_probability",
    "clv_stimato": "clv", "satisfaction_score": "satisfaction_score",
    "num_polizze": "policy_count", "anzianita_compagnia": "tenure_years",
    "visite_ultimo_anno": "annual_visits",
}
POLICY = {
    "codice_cliente": "customer_id", "prodotto": "product", "area_bisogno": "need_area",
    "premio_totale_annuo": "annual_premium", "stato_polizza": "policy_status",
    "canale_acquisizione": "acquisition_channel", "loss_ratio": "loss_ratio",
    "margine_lordo": "gross_margin", "data_emissione": "data_emissione",
    "data_scadenza": "data_scadenza",
}
INTERACTION = {
    "codice_cliente": "customer_id", "tipo_interazione": "interaction_type",
    "durata_minuti": "duration_minutes", "conversione": "conversion",
    "data_interazione": "interaction_date",
}
GEOGRAPHY = {
    "codice_cliente": "customer_id", "latitudine": "lat", "longitudine": "lon",
    "luogo_residenza": "city", "clv_stimato": "clv",
}
VALUE = {
    "engagement_score": "engagement_score", "churn_probability": "churn_probability",
    "clv_stimato": "clv", "cluster_risposta": "cluster",
}
CLAIM = {
    "data_sinistro": "claim_date", "importo_liquidato": "claim_amount",
    "stato_liquidazione": "status", "prodotto": "product",
}
COMPETITOR = {
    "competitor": "competitor", "tipo_prodotto": "product_type", "premio_medio": "avg_premium",
    "rating_clienti": "rating", "quota_mercato_perc": "market_share",
}
COMPLAINT = {
    "prodotto": "product", "area_bisogno": "need_area", "reclami_e_info": "complaint_type",
}
HOUSING = {"metratura": "size_sqm", "sistema_allarme": "has_alarm", "luogo_residenza": "city"}

# Lifecycle stages and the years of tenure between them.
STAGES = ("New (0-2y)", "Growing (2-5y)", "Mature (5-10y)", "Loyal (10y+)")
STAGE_YEARS = (2, 5, 10)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def customer_demographics(clienti: DataFrame) -> DataFrame:
    return renamed(clienti, DEMOGRAPHICS)


def policy_extract(polizze: DataFrame) -> DataFrame:
    return renamed(polizze, POLICY)


def interaction_extract(interazioni: DataFrame) -> DataFrame:
    return renamed(interazioni, INTERACTION)


def customer_geography(clienti: DataFrame) -> DataFrame:
    """Customers with both coordinates."""
    return with_known(renamed(clienti, GEOGRAPHY), "lat", "lon")


def value_extract(clienti: DataFrame) -> DataFrame:
    return with_known(renamed(clienti, VALUE), "engagement_score")


def claims_extract(sinistri: DataFrame) -> DataFrame:
    """Claims with a date."""
    return with_known(renamed(sinistri, CLAIM), "claim_date")


def competitor_extract(competitors: DataFrame) -> DataFrame:
    return renamed(competitors, COMPETITOR)


def complaints_extract(reclami: DataFrame) -> DataFrame:
    return renamed(reclami, COMPLAINT)


def housing_extract(abitazioni: DataFrame) -> DataFrame:
    return renamed(abitazioni, HOUSING)


def lifecycle_stage_sql(clienti: DataFrame) -> DataFrame:
    """Stage by tenure, lower bounds inclusive; unknown tenure counts as loyal."""
    tenure = F.col("anzianita_compagnia")
    stage = ladder(
        [(tenure < years, label) for years, label in zip(STAGE_YEARS, STAGES)],
        otherwise=STAGES[-1],
    )
    return with_known(clienti, "engagement_score").select(
        tenure.alias("tenure_years"), "engagement_score", "churn_probability",
        F.col("num_polizze").alias("policy_count"),
        F.col("visite_ultimo_anno").alias("annual_visits"),
        stage.alias("lifecycle_stage"),
    )


def lifecycle_stage_binned(demographics: DataFrame) -> DataFrame:
    """Stage by tenure, upper bounds inclusive; tenure 0 or unknown has no stage."""
    tenure = F.col("tenure_years")
    steps = [(tenure <= 0, None)]
    steps += [(tenure <= years, label) for years, label in zip(STAGE_YEARS, STAGES)]
    steps.append((tenure.isNotNull(), STAGES[-1]))
    return demographics.withColumn("lifecycle_stage", ladder(steps))


@dataclass(frozen=True)
class CustomerFilter:
    """Inclusive age and income ranges and an optional cluster; None leaves a range open."""

    age: tuple[float | None, float | None] = (None, None)
    income: tuple[float | None, float | None] = (None, None)
    cluster: str | None = None


def filter_customers(demographics: DataFrame, where: CustomerFilter) -> DataFrame:
    """Customers inside the ranges; unknown age or income never passes, open range or not."""
    kept = with_known(demographics, "age", "income")
    for column, (low, high) in (("age", where.age), ("income", where.income)):
        if low is not None:
            kept = kept.filter(F.col(column) >= low)
        if high is not None:
            kept = kept.filter(F.col(column) <= high)
    return kept if where.cluster is None else kept.filter(F.col("cluster") == where.cluster)


def filter_ranges(demographics: DataFrame) -> DataFrame:
    """Widest ranges a filter can take, in one row."""
    return demographics.agg(
        F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        F.min("income").alias("min_income"), F.max("income").alias("max_income"),
    )


def cluster_choices(demographics: DataFrame) -> DataFrame:
    """Clusters a filter can name, sorted."""
    return with_known(demographics.select("cluster"), "cluster").distinct().orderBy("cluster")


def of_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows that belong to one of the customers."""
    return df.join(customers.select("customer_id"), "customer_id", "left_semi")


def customer_value_metrics(
    customers: DataFrame,
    required: Sequence[str] = ("engagement_score", "churn_probability", "clv"),
) -> DataFrame:
    """Customers for whom all required scores are known."""
    return with_known(customers, *required)
