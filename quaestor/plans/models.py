"""Customer aggregates and marts.

Facts are aggregated per customer before they meet the customer table, so a customer that owns
a large share of the facts is reduced on the map side and never fills one join task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaestor.functions.expressions import as_of_date, ladder, ratio, year_boundaries
from quaestor.schemas import CUSTOMER_KEY

AsOf = date | str | Column | None

# Domain words, class names and thresholds that the results depend on.
ACTIVE, EXPIRED = "Attiva", "Scaduta"
PROTECTION, INVESTMENT = "Protezione", "Risparmio e Investimento"
AGENCY, ONLINE = "Rete Diretta Agenziale", "Online"
PREMIUM_CLV, LOYAL_CHURN, HIGH_CHURN, GROWTH = 50000, 0.3, 0.7, 0.5
LOW_FREQUENCY, MEDIUM_FREQUENCY = 0.5, 1.5
HIGH_PREMIUM, MEDIUM_PREMIUM = 5000, 2000
HIGH_MARGIN, MEDIUM_MARGIN = 1000, 500
EXPIRING_WITHIN_DAYS = 90
CLAIM_STATES = {
    "num_sinistri_liquidati": "Liquidato",
    "num_sinistri_in_lavorazione": "In Lavorazione",
    "num_sinistri_respinti": "Respinto",
}
INTERACTION_TYPES = {
    "num_visite_agente": "Visita Agente",
    "num_chat_online": "Chat Online",
    "num_telefonate": "Telefono",
    "num_app_mobile": "App Mobile",
    "num_email": "Email",
}
OUTCOMES = {
    "num_esiti_positivi": "Positivo",
    "num_esiti_negativi": "Negativo",
    "num_esiti_neutrali": "Neutrale",
}
REASONS = {
    "num_consulenza": "Consulenza",
    "num_reclami_interazioni": "Reclamo",
    "num_pagamenti": "Pagamento Premio",
    "num_info_prodotto": "Informazioni Prodotto",
}

PROFILE = [
    CUSTOMER_KEY, "nome", "cognome", "eta", "professione", "reddito", "stato_civile", "agenzia",
    "zona_residenza", "engagement_score", "churn_probability", "clv_stimato",
    "satisfaction_score", "potenziale_crescita",
]


def _counts(column: str, words: dict[str, str]) -> list[Column]:
    return [F.count_if(F.col(column) == word).alias(name) for name, word in words.items()]


def int_customer_policies(clienti: DataFrame, polizze: DataFrame) -> DataFrame:
    """One row per customer with the totals of the policies held.

    A customer without policies counts one policy in total (the unmatched outer row) and has
    NULL amounts. Customer rows that repeat the whole profile merge and add up, as they would if
    the joined rows were grouped by the profile. Both sides are grouped before the join: neither
    copies of a customer nor the policies of one customer travel row by row, and on tables
    bucketed by customer neither grouping nor join moves the customers.
    """
    per_customer = polizze.groupBy(CUSTOMER_KEY).agg(
        F.count_distinct("prodotto").alias("products"),
        F.count(F.lit(1)).alias("policies"),
        F.count_if(F.col("stato_polizza") == ACTIVE).alias("active"),
        F.count_if(F.col("stato_polizza") == EXPIRED).alias("expired"),
        F.sum("premio_totale_annuo").alias("premium"),
        F.avg("premio_totale_annuo").alias("mean_premium"),
        F.sum("massimale").alias("coverage"),
        F.sum("margine_lordo").alias("margin"),
        F.avg("loss_ratio").alias("loss_ratio"),
        F.count_if(F.col("area_bisogno") == PROTECTION).alias("protection"),
        F.count_if(F.col("area_bisogno") == INVESTMENT).alias("investment"),
        F.count_if(F.col("canale_acquisizione") == AGENCY).alias("agency"),
        F.count_if(F.col("canale_acquisizione") == ONLINE).alias("online"),
    )

    profiles = clienti.groupBy(*PROFILE).agg(F.count(F.lit(1)).alias("copies"))
    copies = F.col("copies")

    def added(name: str, unmatched: int = 0) -> Column:
        return copies * F.coalesce(F.col(name), F.lit(unmatched))

    return profiles.join(per_customer, CUSTOMER_KEY, "left").select(
        *PROFILE,
        F.coalesce("products", F.lit(0)).alias("num_prodotti_distinti"),
        added("policies", unmatched=1).alias("num_polizze_totali"),
        added("active").alias("num_polizze_attive"),
        added("expired").alias("num_polizze_scadute"),
        (copies * F.col("premium")).alias("premio_annuo_totale"),
        F.col("mean_premium").alias("premio_annuo_medio"),
        (copies * F.col("coverage")).alias("massimale_totale"),
        (copies * F.col("margin")).alias("margine_lordo_totale"),
        F.col("loss_ratio").alias("loss_ratio_medio"),
        added("protection").alias("num_prodotti_protezione"),
        added("investment").alias("num_prodotti_investimento"),
        added("agency").alias("num_canale_agenziale"),
        added("online").alias("num_canale_online"),
    )


def int_customer_claims(sinistri: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per customer with claims; the yearly frequency is NULL within the first year."""
    years = year_boundaries(F.min("data_sinistro"), as_of_date(as_of))
    return sinistri.groupBy(CUSTOMER_KEY).agg(
        F.count(F.lit(1)).alias("num_sinistri_totali"),
        F.count_distinct("prodotto").alias("num_prodotti_con_sinistri"),
        *_counts("stato_liquidazione", CLAIM_STATES),
        F.sum("importo_liquidato").alias("importo_totale_liquidato"),
        F.avg("importo_liquidato").alias("importo_medio_liquidato"),
        F.max("importo_liquidato").alias("importo_max_liquidato"),
        F.min("data_sinistro").alias("data_primo_sinistro"),
        F.max("data_sinistro").alias("data_ultimo_sinistro"),
        ratio(F.count(F.lit(1)), years).alias("frequenza_sinistri_annua"),
    )


def int_customer_interactions(interazioni: DataFrame) -> DataFrame:
    """One row per customer with interactions."""
    first, last = F.min("data_interazione"), F.max("data_interazione")
    converted = F.count_if(F.col("conversione"))
    return interazioni.groupBy(CUSTOMER_KEY).agg(
        F.count(F.lit(1)).alias("num_interazioni_totali"),
        F.count_distinct("tipo_interazione").alias("num_tipi_interazione"),
        *_counts("tipo_interazione", INTERACTION_TYPES),
        *_counts("esito", OUTCOMES),
        converted.alias("num_conversioni"),
        ratio(converted, F.count(F.lit(1))).alias("tasso_conversione"),
        *_counts("motivo", REASONS),
        F.avg("durata_minuti").alias("durata_media_minuti"),
        F.sum("durata_minuti").alias("durata_totale_minuti"),
        F.max("durata_minuti").alias("durata_max_minuti"),
        first.alias("prima_interazione"),
        last.alias("ultima_interazione"),
        F.datediff(last, first).cast("long").alias("giorni_tra_prima_ultima"),
    )


def dim_customers(
    customer_policies: DataFrame, interactions: DataFrame, claims: DataFrame
) -> DataFrame:
    """One row per customer: profile, totals, and segment, risk and value class."""
    contacts = interactions.select(
        CUSTOMER_KEY, "num_interazioni_totali", "num_conversioni", "tasso_conversione",
        "num_esiti_positivi", F.col("durata_media_minuti").alias("durata_media_interazioni"),
    )
    losses = claims.select(
        CUSTOMER_KEY, "num_sinistri_totali", "importo_totale_liquidato", "frequenza_sinistri_annua"
    )
    zero_filled = [c for c in contacts.columns + losses.columns if c != CUSTOMER_KEY]
    joined = (
        customer_policies.join(contacts, CUSTOMER_KEY, "left")
        .join(losses, CUSTOMER_KEY, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero_filled})
    )
    clv, churn = F.col("clv_stimato"), F.col("churn_probability")
    frequency, premium = F.col("frequenza_sinistri_annua"), F.col("premio_annuo_totale")
    return joined.select(
        *PROFILE[:9],
        "num_prodotti_distinti", "num_polizze_totali", "num_polizze_attive",
        "premio_annuo_totale", "premio_annuo_medio", "massimale_totale", "margine_lordo_totale",
        "num_prodotti_protezione", "num_prodotti_investimento",
        *PROFILE[9:],
        *zero_filled,
        ladder(
            [
                ((clv > PREMIUM_CLV) & (churn < LOYAL_CHURN), "Premium Loyal"),
                ((clv > PREMIUM_CLV) & (churn >= LOYAL_CHURN), "Premium At Risk"),
                (churn > HIGH_CHURN, "High Churn Risk"),
                (F.col("potenziale_crescita") > GROWTH, "Growth Opportunity"),
                (F.col("num_polizze_attive") == 0, "Inactive"),
            ],
            otherwise="Standard",
        ).alias("segmento_cliente"),
        ladder(
            [
                (F.col("num_sinistri_totali") == 0, "No Claims"),
                (frequency < LOW_FREQUENCY, "Low Risk"),
                (frequency < MEDIUM_FREQUENCY, "Medium Risk"),
            ],
            otherwise="High Risk",
        ).alias("classificazione_rischio"),
        ladder(
            [
                (premium > HIGH_PREMIUM, "High Value"),
                (premium > MEDIUM_PREMIUM, "Medium Value"),
                (premium > 0, "Low Value"),
            ],
            otherwise="No Active Policies",
        ).alias("classificazione_valore"),
    )


def fact_policies(polizze: DataFrame, clienti: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per policy with its customer, day counts, status flags and margin band.

    A policy whose customer is missing is kept. Policies stream past a hash table of their partition's
    customers, so no task sorts them, however many are merged into it: rows of a key alone take little
    room in a shuffle and much in a sort. Adaptive execution splits a customer that owns too many
    policies.
    """
    today = as_of_date(as_of)
    customer = clienti.select(
        CUSTOMER_KEY, "nome", "cognome", "eta", "professione", "agenzia", "zona_residenza"
    )
    margin, expiry = F.col("margine_lordo"), F.col("data_scadenza")
    expiring = expiry.between(today, F.date_add(today, EXPIRING_WITHIN_DAYS))
    return polizze.join(customer.hint("shuffle_hash"), CUSTOMER_KEY, "left").select(
        *polizze.columns,
        *[c for c in customer.columns if c != CUSTOMER_KEY],
        F.datediff(today, "data_emissione").cast("long").alias("giorni_dalla_emissione"),
        F.datediff("data_scadenza", today).cast("long").alias("giorni_alla_scadenza"),
        F.when(F.col("stato_polizza") == ACTIVE, 1).otherwise(0).alias("attiva"),
        F.when(expiry < today, 1).otherwise(0).alias("scaduta"),
        F.when(expiring, 1).otherwise(0).alias("in_scadenza"),
        ladder(
            [
                (margin > HIGH_MARGIN, "High Margin"),
                (margin > MEDIUM_MARGIN, "Medium Margin"),
                (margin > 0, "Low Margin"),
            ],
            otherwise="Negative Margin",
        ).alias("fascia_profittabilita"),
    )


def mart_competitor_analysis(
    polizze: DataFrame, competitors: DataFrame, company: str
) -> DataFrame:
    """Own active products by need area next to competitor products, ranked per product type.

    `company` names the own rows. NULLs rank last in every direction; ties leave gaps.
    """
    own = (
        polizze.filter(F.col("stato_polizza") == ACTIVE)
        .groupBy(F.col("area_bisogno").alias("tipo_prodotto"))
        .agg(
            F.avg("premio_totale_annuo").alias("premio_medio"),
            F.avg("massimale").alias("massimale_medio"),
            F.count(F.lit(1)).alias("num_polizze"),
        )
        .withColumns({
            "compagnia": F.lit(company),
            "rating_clienti": F.lit(None).cast("double"),
            "quota_mercato_perc": F.lit(None).cast("double"),
            "fonte": F.lit("Internal"),
        })
    )
    market = competitors.select(
        F.col("competitor").alias("compagnia"),
        "tipo_prodotto",
        F.col("premio_medio").cast("double").alias("premio_medio"),
        F.col("massimale_medio").cast("double").alias("massimale_medio"),
        "rating_clienti",
        "quota_mercato_perc",
        F.lit(None).cast("long").alias("num_polizze"),
        F.lit("Competitor").alias("fonte"),
    )
    per_type = Window.partitionBy("tipo_prodotto")

    def rank(order: Column) -> Column:
        return F.rank().over(per_type.orderBy(order)).cast("long")

    return market.unionByName(own).withColumns({
        "rank_premio": rank(F.asc_nulls_last("premio_medio")),
        "rank_copertura": rank(F.desc_nulls_last("massimale_medio")),
        "rank_rating": rank(F.desc_nulls_last("rating_clienti")),
    })
