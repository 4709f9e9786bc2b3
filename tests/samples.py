"""Hand-made rows with the edge cases of the models."""

from __future__ import annotations

import csv
from datetime import date
from pathlib import Path

from quaestor.schemas import RAW_TABLES, raw_schema

AS_OF = "2025-01-01"
COMPANY = "Casa Nostra"


def raw_frame(spark, table, rows):
    """A raw table from rows given by staging name; what is not named is NULL."""
    names = {c.staging: c.header for c in RAW_TABLES[table] if c.staging}
    headers = [c.header for c in RAW_TABLES[table]]
    tuples = []
    for row in rows:
        by_header = {names[k]: v for k, v in row.items()}
        tuples.append(tuple(by_header.get(h) for h in headers))
    return spark.createDataFrame(tuples, raw_schema(table))


def customer(key, **values):
    return {
        "codice_cliente": key, "nome": f"N{key}", "cognome": f"C{key}", "eta": 40,
        "professione": "Medico", "reddito": 1000, "stato_civile": "Single", "agenzia": "A1",
        "zona_residenza": "Z1", "luogo_residenza": "Roma", "engagement_score": 50.0,
        "churn_probability": 0.5, "clv_stimato": 10000, "satisfaction_score": 70.0,
        "potenziale_crescita": 0.1, "num_polizze": 1, "anzianita_compagnia": 3,
        "visite_ultimo_anno": 2, "latitudine": 41.0, "longitudine": 12.0,
        "cluster_risposta": "High_Responder", **values,
    }


def policy(key, premium, **values):
    return {
        "codice_cliente": key, "prodotto": "Casa", "area_bisogno": "Protezione",
        "stato_polizza": "Attiva", "canale_acquisizione": "Online",
        "data_emissione": date(2020, 1, 1), "data_scadenza": date(2026, 1, 1),
        "premio_totale_annuo": premium, "massimale": 1000.0, "margine_lordo": 10,
        "loss_ratio": 0.5, **values,
    }


def claim(key, day, amount=100, **values):
    return {
        "codice_cliente": key, "prodotto": "Casa", "area_bisogno": "Protezione",
        "sinistro": "Furto", "data_sinistro": day, "importo_liquidato": amount,
        "stato_liquidazione": "Liquidato", **values,
    }


def contact(key, day, kind="Email", **values):
    return {
        "codice_cliente": key, "data_interazione": day, "tipo_interazione": kind,
        "motivo": "Reclamo", "durata_minuti": 10.0, "esito": "Positivo", "conversione": False,
        **values,
    }


CUSTOMERS = [
    customer(1, clv_stimato=50000, churn_probability=0.7, potenziale_crescita=0.5),
    customer(2, clv_stimato=50001, churn_probability=0.3),
    customer(3, clv_stimato=50001, churn_probability=0.29),
    customer(4, churn_probability=0.71),
    customer(5, potenziale_crescita=0.51),
    customer(6, churn_probability=None, clv_stimato=60000),
]
POLICIES = [
    policy(1, 5000.0, margine_lordo=1000, data_scadenza=date(2025, 1, 1)),
    policy(2, 5000.0, margine_lordo=1001, data_scadenza=date(2025, 4, 1)),
    policy(2, 0.5, margine_lordo=500, data_scadenza=date(2025, 4, 2), prodotto="Vita",
           area_bisogno="Risparmio e Investimento", canale_acquisizione="Rete Diretta Agenziale"),
    policy(3, 2000.0, margine_lordo=501, data_scadenza=date(2024, 12, 31)),
    policy(4, 0.0, margine_lordo=0, stato_polizza="Scaduta"),
    policy(5, None, margine_lordo=None, data_scadenza=None),
    policy(99, 300.0, margine_lordo=1),
]
CLAIMS = [
    claim(1, date(2024, 12, 31)),                       # one year boundary: frequency 1
    claim(2, date(2023, 6, 1)),                         # two boundaries: frequency 0.5
    *[claim(3, date(2023, 6, 1)) for _ in range(3)],    # frequency 1.5
    *[claim(4, date(2025, 1, 1)) for _ in range(4)],    # this year: no frequency
    claim(5, date(2020, 1, 1), sinistro=None),          # without description
    claim(5, date(2020, 1, 1), stato_liquidazione="Respinto"),
]
CONTACTS = [
    contact(1, date(2024, 1, 1), conversione=True),
    contact(1, date(2024, 1, 11), kind="Telefono", esito="Negativo", durata_minuti=None),
    contact(1, date(2024, 1, 5), kind="Telefono", esito="Neutrale", durata_minuti=20.0),
    contact(2, date(2024, 1, 1), durata_minuti=None, conversione=None, motivo="Consulenza"),
]
COMPETITORS = [
    {"competitor": "Uno", "tipo_prodotto": "Casa", "premio_medio": 300, "massimale_medio": 10,
     "rating_clienti": 4.0, "quota_mercato_perc": 10.0},
    {"competitor": "Due", "tipo_prodotto": "Casa", "premio_medio": 300, "massimale_medio": 30,
     "rating_clienti": None, "quota_mercato_perc": 5.0},
    {"competitor": "Tre", "tipo_prodotto": "Casa", "premio_medio": None, "massimale_medio": None,
     "rating_clienti": 5.0, "quota_mercato_perc": 2.5},
    {"competitor": "Quattro", "tipo_prodotto": "Casa", "premio_medio": 400,
     "massimale_medio": 20, "rating_clienti": 4.0, "quota_mercato_perc": None},
]
COMPLAINTS = [
    {"codice_cliente": 1, "prodotto": "Casa", "area_bisogno": "Protezione",
     "reclami_e_info": "Reclamo"},
    {"codice_cliente": 1, "prodotto": "Casa", "area_bisogno": "Protezione",
     "reclami_e_info": None},
]
HOMES = [
    {"codice_cliente": 1, "luogo_residenza": "Roma", "indirizzo": 'Via "Nuova", 1',
     "metratura": 90, "sistema_allarme": True},
    {"codice_cliente": 2, "luogo_residenza": "Roma", "indirizzo": "Via Vecchia, 2",
     "metratura": 60, "sistema_allarme": None},
]
ROWS = {
    "clienti": CUSTOMERS, "polizze": POLICIES, "sinistri": CLAIMS, "reclami": COMPLAINTS,
    "abitazioni": HOMES, "interazioni_clienti": CONTACTS, "competitor_prodotti": COMPETITORS,
}


def raw_frames(spark, **replaced):
    return {t: raw_frame(spark, t, replaced.get(t, rows)) for t, rows in ROWS.items()}


def write_csv(folder: Path, tables=tuple(ROWS)):
    """The sample rows as delivered files."""
    for table in tables:
        columns = RAW_TABLES[table]
        with open(folder / f"{table}.csv", "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow([c.header for c in columns])
            for row in ROWS[table]:
                out.writerow([row.get(c.staging) for c in columns])
