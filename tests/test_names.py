"""Every header, report name and counted word, spelled out apart from the package."""

import pytest

import samples
from quaestor.operators import extracts
from quaestor.operators.staging import stage
from quaestor.plans import models
from quaestor.schemas import RAW_TABLES

# header of the delivered file -> staging name; None is dropped
HEADERS = {
    "clienti": {
        "Nome": "nome",
        "Cognome": "cognome",
        "Età": "eta",
        "Luogo di Nascita": "luogo_nascita",
        "Luogo di Residenza": "luogo_residenza",
        "Professione": "professione",
        "Reddito": "reddito",
        "Reddito Familiare": "reddito_familiare",
        "Numero Figli": "numero_figli",
        "Anzianità con la Compagnia": "anzianita_compagnia",
        "Stato Civile": "stato_civile",
        "Numero Familiari a Carico": "numero_familiari_carico",
        "Reddito Stimato": "reddito_stimato",
        "Patrimonio Finanziario Stimato": "patrimonio_finanziario",
        "Patrimonio Reale Stimato": "patrimonio_reale",
        "Consumi Stimati": "consumi_stimati",
        "Propensione Acquisto Prodotti Vita": "propensione_vita",
        "Propensione Acquisto Prodotti Danni": "propensione_danni",
        "Valore Immobiliare Medio": "valore_immobiliare_medio",
        "Probabilità Furti Stimata": "probabilita_furti",
        "Probabilità Rapine Stimata": "probabilita_rapine",
        "Zona di Residenza": "zona_residenza",
        "codice_cliente": "codice_cliente",
        "Agenzia": "agenzia",
        "Latitudine": "latitudine",
        "Longitudine": "longitudine",
        "Num_Polizze": "num_polizze",
        "Engagement_Score": "engagement_score",
        "Churn_Probability": "churn_probability",
        "CLV_Stimato": "clv_stimato",
        "Potenziale_Crescita": "potenziale_crescita",
        "Reclami_Totali": "reclami_totali",
        "Satisfaction_Score": "satisfaction_score",
        "Data_Ultima_Visita": "data_ultima_visita",
        "Visite_Ultimo_Anno": "visite_ultimo_anno",
        "Cluster_Risposta": "cluster_risposta",
    },
    "polizze": {
        "Unnamed: 0": None,
        "codice_cliente": "codice_cliente",
        "Prodotto": "prodotto",
        "Area di Bisogno": "area_bisogno",
        "Data di Emissione": "data_emissione",
        "Premio_Ricorrente": "premio_ricorrente",
        "Premio_Unico": "premio_unico",
        "Capitale_Rivalutato": "capitale_rivalutato",
        "Massimale": "massimale",
        "Stato_Polizza": "stato_polizza",
        "Data_Scadenza": "data_scadenza",
        "Canale_Acquisizione": "canale_acquisizione",
        "Commissione_Perc": "commissione_perc",
        "Premio_Totale_Annuo": "premio_totale_annuo",
        "Commissione_Euro": "commissione_euro",
        "Costi_Operativi": "costi_operativi",
        "Margine_Lordo": "margine_lordo",
        "Importo_Liquidato": "importo_liquidato",
        "Sinistri_Totali": "sinistri_totali",
        "Loss_Ratio": "loss_ratio",
    },
    "sinistri": {
        "codice_cliente": "codice_cliente",
        "Prodotto": "prodotto",
        "Area di Bisogno": "area_bisogno",
        "Sinistro": "sinistro",
        "Data_Sinistro": "data_sinistro",
        "Importo_Liquidato": "importo_liquidato",
        "Stato_Liquidazione": "stato_liquidazione",
    },
    "reclami": {
        "codice_cliente": "codice_cliente",
        "Prodotto": "prodotto",
        "Area di Bisogno": "area_bisogno",
        "Reclami_e_info": "reclami_e_info",
    },
    "abitazioni": {
        "codice_cliente": "codice_cliente",
        "Luogo di Residenza": "luogo_residenza",
        "Indirizzo": "indirizzo",
        "Metratura": "metratura",
        "Sistema_Allarme": "sistema_allarme",
    },
    "interazioni_clienti": {
        "codice_cliente": "codice_cliente",
        "Data_Interazione": "data_interazione",
        "Tipo_Interazione": "tipo_interazione",
        "Motivo": "motivo",
        "Durata_Minuti": "durata_minuti",
        "Esito": "esito",
        "Note": "note",
        "Conversione": "conversione",
    },
    "competitor_prodotti": {
        "Competitor": "competitor",
        "Tipo_Prodotto": "tipo_prodotto",
        "Premio_Medio": "premio_medio",
        "Massimale_Medio": "massimale_medio",
        "Rating_Clienti": "rating_clienti",
        "Quota_Mercato_Perc": "quota_mercato_perc",
        "Coperture_Extra": "coperture_extra",
    },
}

# extract -> (table, staging column -> report column)
REPORT = {
    "customer_demographics": ("clienti", {
        "codice_cliente": "customer_id",
        "eta": "age",
        "reddito": "income",
        "professione": "profession",
        "luogo_residenza": "city",
        "cluster_risposta": "cluster",
        "engagement_score": "engagement_score",
        "churn_probability": "churn_probability",
        "clv_stimato": "clv",
        "satisfaction_score": "satisfaction_score",
        "num_polizze": "policy_count",
        "anzianita_compagnia": "tenure_years",
        "visite_ultimo_anno": "annual_visits",
    }),
    "policy_extract": ("polizze", {
        "codice_cliente": "customer_id",
        "prodotto": "product",
        "area_bisogno": "need_area",
        "premio_totale_annuo": "annual_premium",
        "stato_polizza": "policy_status",
        "canale_acquisizione": "acquisition_channel",
        "loss_ratio": "loss_ratio",
        "margine_lordo": "gross_margin",
        "data_emissione": "data_emissione",
        "data_scadenza": "data_scadenza",
    }),
    "interaction_extract": ("interazioni_clienti", {
        "codice_cliente": "customer_id",
        "tipo_interazione": "interaction_type",
        "durata_minuti": "duration_minutes",
        "conversione": "conversion",
        "data_interazione": "interaction_date",
    }),
    "customer_geography": ("clienti", {
        "codice_cliente": "customer_id",
        "latitudine": "lat",
        "longitudine": "lon",
        "luogo_residenza": "city",
        "clv_stimato": "clv",
    }),
    "value_extract": ("clienti", {
        "engagement_score": "engagement_score",
        "churn_probability": "churn_probability",
        "clv_stimato": "clv",
        "cluster_risposta": "cluster",
    }),
    "claims_extract": ("sinistri", {
        "data_sinistro": "claim_date",
        "importo_liquidato": "claim_amount",
        "stato_liquidazione": "status",
        "prodotto": "product",
    }),
    "competitor_extract": ("competitor_prodotti", {
        "competitor": "competitor",
        "tipo_prodotto": "product_type",
        "premio_medio": "avg_premium",
        "rating_clienti": "rating",
        "quota_mercato_perc": "market_share",
    }),
    "complaints_extract": ("reclami", {
        "prodotto": "product",
        "area_bisogno": "need_area",
        "reclami_e_info": "complaint_type",
    }),
    "housing_extract": ("abitazioni", {
        "metratura": "size_sqm",
        "sistema_allarme": "has_alarm",
        "luogo_residenza": "city",
    }),
}

# counted word -> column of the aggregate
CLAIM_WORDS = {
    "Liquidato": "num_sinistri_liquidati",
    "In Lavorazione": "num_sinistri_in_lavorazione",
    "Respinto": "num_sinistri_respinti",
}
KIND_WORDS = {
    "Visita Agente": "num_visite_agente",
    "Chat Online": "num_chat_online",
    "Telefono": "num_telefonate",
    "App Mobile": "num_app_mobile",
    "Email": "num_email",
}
OUTCOME_WORDS = {
    "Positivo": "num_esiti_positivi",
    "Negativo": "num_esiti_negativi",
    "Neutrale": "num_esiti_neutrali",
}
REASON_WORDS = {
    "Consulenza": "num_consulenza",
    "Reclamo": "num_reclami_interazioni",
    "Pagamento Premio": "num_pagamenti",
    "Informazioni Prodotto": "num_info_prodotto",
}


def sample_value(place, kind):
    """A value no other column of the table has, as far as its type allows."""
    return {
        "string": f"text {place}", "bigint": 1000 + place, "double": 0.5 + place,
        "date": samples.date(2001, 1 + place % 12, 1 + place % 28), "boolean": True,
    }[kind]


def one_row(spark, table):
    fields = [(c.header, c.type.simpleString()) for c in RAW_TABLES[table]]
    assert [h for h, _ in fields] == list(HEADERS[table])
    row = tuple(sample_value(i, kind) for i, (_, kind) in enumerate(fields))
    schema = ", ".join(f"`{h}` {kind}" for h, kind in fields)
    return spark.createDataFrame([row], schema), dict(zip(HEADERS[table].values(), row))


@pytest.mark.parametrize("table", sorted(HEADERS))
def test_staging_names(spark, table):
    raw, expected = one_row(spark, table)
    (row,) = stage(table, raw).collect()
    expected.pop(None, None)
    assert row.asDict() == expected


@pytest.mark.parametrize("name", sorted(REPORT))
def test_report_names(spark, name):
    table, names = REPORT[name]
    raw, staged = one_row(spark, table)
    (row,) = getattr(extracts, name)(stage(table, raw)).collect()
    assert row.asDict() == {new: staged[old] for old, new in names.items()}


def words_counted(rows, words):
    """Each word occurs in as many rows as its place says."""
    (row,) = rows.collect()
    assert {column: row[column] for column in words.values()} == {
        column: place for place, column in enumerate(words.values(), 1)
    }


def test_claim_words(spark):
    rows = [
        samples.claim(1, samples.date(2020, 1, 1), stato_liquidazione=word)
        for place, word in enumerate(CLAIM_WORDS, 1) for _ in range(place)
    ]
    staged = stage("sinistri", samples.raw_frame(spark, "sinistri", rows))
    words_counted(models.int_customer_claims(staged, samples.AS_OF), CLAIM_WORDS)


@pytest.mark.parametrize(
    "column, words",
    [("tipo_interazione", KIND_WORDS), ("esito", OUTCOME_WORDS), ("motivo", REASON_WORDS)],
)
def test_contact_words(spark, column, words):
    rows = [
        {**samples.contact(1, samples.date(2024, 1, 1)), column: word}
        for place, word in enumerate(words, 1) for _ in range(place)
    ]
    staged = stage("interazioni_clienti", samples.raw_frame(spark, "interazioni_clienti", rows))
    words_counted(models.int_customer_interactions(staged), words)


def test_nullability_is_described(spark):
    from quaestor.sources.tables import describe_table

    df = spark.range(1).selectExpr("id", "CAST(NULL AS string) AS t")
    assert [tuple(r) for r in describe_table(df).collect()] == [("id", "bigint", False), ("t", "string", True)]


def test_forced_equal_hashes_do_not_make_duplicates(spark):
    from pyspark.sql import functions as F

    from quaestor.operators.profile import duplicate_rows

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "a"), (None, "a"), (1, None)], "x int, y string")
    same = lambda _: [F.lit(1).alias("hash_1_"), F.lit(2).alias("hash_2_")]
    assert tuple(duplicate_rows(df, same).first()) == tuple(duplicate_rows(df).first()) == (6, 2)
    assert tuple(duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_duplicates_shuffle_hashes_not_rows(spark):
    from quaestor.operators.profile import duplicate_rows

    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS wide")
    plan = duplicate_rows(df)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "left_semi" in text.lower() or "LeftSemi" in text


def test_duplicates_shuffle_one_hash_beside_a_row(spark):
    from quaestor.operators.profile import duplicate_rows

    df = spark.range(1000).selectExpr("id % 600 AS x", "NULL AS y")
    found = duplicate_rows(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash_1_" in plan and "hash_2_" not in plan
    assert tuple(found.first()) == (1000, 400)


def test_each_table_is_read_once_for_all_key_checks(spark, tmp_path):
    from quaestor.operators.checks import RELATIONSHIP, UNIQUE, Check, check_report

    tables = {}
    for name in ("p", "a", "b"):
        spark.range(50).selectExpr("id AS k", "id % 7 AS j").write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    declared = [Check(UNIQUE, "p", "k")] + [
        Check(RELATIONSHIP, t, c, parent="p", parent_column="k") for t in "ab" for c in "kj"
    ]
    report = check_report(tables, declared)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert all(r.failures == 0 for r in report.collect())
    assert plan.count("FileScan") == 3 and plan.count("Exchange hashpartitioning") == 1


def test_building_a_box_starts_no_job(spark):
    from quaestor.operators import distributions

    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    df = spark.range(100).selectExpr("id % 3 AS g", "CAST(id AS double) AS x")
    box = distributions.box_summary(df, "x", "g", few_groups=True)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert {r.g: (r.n, r.median) for r in box.collect()} == {0: (34, 49.5), 1: (33, 49.0), 2: (33, 50.0)}
