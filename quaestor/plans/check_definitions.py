"""The declared checks of raw tables, staging, customer aggregates and marts."""

from __future__ import annotations

from quaestor.operators.checks import (
    EXPRESSION, NOT_NULL, RANGE, RELATIONSHIP, UNIQUE, VALUES, Check,
)
from quaestor.schemas import CUSTOMER_KEY


def _unique(table: str, column: str = CUSTOMER_KEY) -> Check:
    return Check(UNIQUE, table, column)


def _not_null(table: str, *columns: str) -> list[Check]:
    return [Check(NOT_NULL, table, c) for c in columns]


def _parent(table: str, parent: str) -> Check:
    return Check(RELATIONSHIP, table, CUSTOMER_KEY, parent=parent, parent_column=CUSTOMER_KEY)


def _range(table: str, column: str, low: float | None, high: float | None = None) -> Check:
    return Check(RANGE, table, column, low=low, high=high)


def _holds(table: str, expression: str, *columns: str, severity: str = "error") -> list[Check]:
    return [Check(EXPRESSION, table, c, expression=expression, severity=severity) for c in columns]


# Which property is declared for which column.
SOURCE_CHECKS = [
    _unique("clienti"),
    *_not_null("clienti", CUSTOMER_KEY, "Età"),
    *_not_null("polizze", CUSTOMER_KEY),
    _parent("polizze", "clienti"),
    _parent("sinistri", "clienti"),
    _parent("reclami", "clienti"),
    _parent("abitazioni", "clienti"),
    *_not_null("interazioni_clienti", CUSTOMER_KEY),
    _parent("interazioni_clienti", "clienti"),
]

STAGING_CHECKS = [
    _unique("stg_clienti"),
    *_not_null("stg_clienti", CUSTOMER_KEY, "eta"),
    _range("stg_clienti", "eta", 18, 100),
    _range("stg_clienti", "engagement_score", 0, 100),
    _range("stg_clienti", "churn_probability", 0, 1),
    _range("stg_clienti", "satisfaction_score", 0, 100),
    *_not_null("stg_polizze", CUSTOMER_KEY),
    _parent("stg_polizze", "stg_clienti"),
    _range("stg_polizze", "premio_totale_annuo", 0),
    _range("stg_polizze", "loss_ratio", 0, 5),
    _parent("stg_sinistri", "stg_clienti"),
    *_not_null("stg_interazioni_clienti", CUSTOMER_KEY, "data_interazione"),
    _parent("stg_interazioni_clienti", "stg_clienti"),
]

POLICY_COUNTS = (
    "num_polizze_totali", "num_polizze_attive", "num_polizze_scadute", "num_prodotti_distinti",
    "num_prodotti_protezione", "num_prodotti_investimento", "num_canale_agenziale",
    "num_canale_online",
)
CLAIM_STATE_COUNTS = (
    "num_sinistri_liquidati", "num_sinistri_in_lavorazione", "num_sinistri_respinti",
)
INTERACTION_COUNTS = (
    "num_visite_agente", "num_chat_online", "num_telefonate", "num_app_mobile", "num_email",
    "num_esiti_positivi", "num_esiti_negativi", "num_esiti_neutrali", "num_conversioni",
    "tasso_conversione", "num_consulenza", "num_reclami_interazioni", "num_pagamenti",
    "num_info_prodotto",
)

_P, _C, _I = "int_customer_policies", "int_customer_claims", "int_customer_interactions"

INTERMEDIATE_CHECKS = [
    _unique(_P),
    _parent(_P, "stg_clienti"),
    *_not_null(_P, CUSTOMER_KEY, "nome", "cognome", "eta", *POLICY_COUNTS),
    *_holds(_P, ">= 0", *POLICY_COUNTS),
    *_holds(_P, "<= num_polizze_totali", "num_polizze_attive", severity="warn"),
    *_holds(_P, ">= 0 OR premio_annuo_totale IS NULL", "premio_annuo_totale"),
    *_holds(_P, ">= 0 OR premio_annuo_medio IS NULL", "premio_annuo_medio"),
    *_holds(_P, ">= 0 OR massimale_totale IS NULL", "massimale_totale"),
    *_holds(_P, ">= 0", "loss_ratio_medio"),
    *_holds(_P, "<= num_polizze_totali", "num_prodotti_protezione", "num_prodotti_investimento"),
    _unique(_C),
    _parent(_C, "stg_clienti"),
    *_not_null(
        _C, CUSTOMER_KEY, "num_sinistri_totali", "num_prodotti_con_sinistri", *CLAIM_STATE_COUNTS,
        "importo_totale_liquidato", "data_primo_sinistro", "data_ultimo_sinistro",
    ),
    *_holds(_C, "> 0", "num_sinistri_totali", "num_prodotti_con_sinistri"),
    *_holds(_C, "<= num_sinistri_totali", "num_prodotti_con_sinistri", *CLAIM_STATE_COUNTS),
    *_holds(_C, ">= 0", *CLAIM_STATE_COUNTS),
    *_holds(
        _C, ">= 0", "importo_totale_liquidato", "importo_medio_liquidato", "importo_max_liquidato"
    ),
    *_holds(_C, ">= importo_medio_liquidato", "importo_max_liquidato", severity="warn"),
    *_holds(_C, ">= data_primo_sinistro", "data_ultimo_sinistro"),
    *_holds(_C, "> 0", "frequenza_sinistri_annua"),
    _unique(_I),
    _parent(_I, "stg_clienti"),
    *_not_null(
        _I, CUSTOMER_KEY, "num_interazioni_totali", "num_tipi_interazione", *INTERACTION_COUNTS,
        "prima_interazione", "ultima_interazione", "giorni_tra_prima_ultima",
    ),
    *_holds(_I, "> 0", "num_interazioni_totali", "num_tipi_interazione"),
    *_holds(_I, "<= 5", "num_tipi_interazione", severity="warn"),
    *_holds(_I, ">= 0", *INTERACTION_COUNTS),
    *_holds(_I, "<= num_interazioni_totali", "num_conversioni"),
    *_holds(_I, "<= 1", "tasso_conversione"),
    *_holds(
        _I, "> 0 OR durata_media_minuti IS NULL OR durata_media_minuti = 0", "durata_media_minuti"
    ),
    *_holds(
        _I, "> 0 OR durata_totale_minuti IS NULL OR durata_totale_minuti = 0",
        "durata_totale_minuti",
    ),
    *_holds(_I, "> 0 OR durata_max_minuti IS NULL OR durata_max_minuti = 0", "durata_max_minuti"),
    *_holds(
        _I, ">= durata_media_minuti OR durata_max_minuti IS NULL OR durata_media_minuti IS NULL",
        "durata_max_minuti", severity="warn",
    ),
    *_holds(_I, ">= prima_interazione", "ultima_interazione"),
    *_holds(_I, ">= 0", "giorni_tra_prima_ultima"),
]

MART_CHECKS = [
    _unique("dim_customers"),
    *_not_null("dim_customers", CUSTOMER_KEY),
    Check(
        VALUES, "dim_customers", "segmento_cliente",
        values=(
            "Premium Loyal", "Premium At Risk", "High Churn Risk", "Growth Opportunity",
            "Inactive", "Standard",
        ),
    ),
    *_not_null("fact_policies", CUSTOMER_KEY),
    _parent("fact_policies", "dim_customers"),
]

CHECKS = [*SOURCE_CHECKS, *STAGING_CHECKS, *INTERMEDIATE_CHECKS, *MART_CHECKS]
