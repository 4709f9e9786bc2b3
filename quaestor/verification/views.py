"""DuckDB SQL for the data model: common table expressions over the source tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quaestor.operators import extracts
from quaestor.operators.staging import REQUIRED_DESCRIPTION
from quaestor.plans import analyses, models
from quaestor.schemas import RAW_TABLES, staging_columns
from quaestor.sources.binding import BINDINGS, source_names

AS_OF = "2001-12-31"  # after the last claim
EARLY = "1997-12-31"  # claims reported after this date make yearly frequencies negative
COMPANY = "Own Company"
SQL_TYPES = {
    T.StringType: "VARCHAR", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
}



def renamed(source: str, names: dict[str, str]) -> str:
    """SELECT of a staging view under report names."""
    columns = ", ".join(f"{old} AS {new}" for old, new in names.items())
    return f"SELECT {columns} FROM {source}"


def counted(column: str, words: dict[str, str]) -> str:
    """Rows per word of a column, for a SELECT list."""
    return ", ".join(
        f"count(*) FILTER (WHERE {column} = '{word}') AS {name}" for name, word in words.items()
    )


VIEWS: dict[str, str] = {}
for _table, _sql in BINDINGS.items():
    VIEWS[f"bind_{_table}"] = _sql.format(**{s: s for s in source_names(_sql)})
for _table, _columns in RAW_TABLES.items():
    _select = ", ".join(
        f'CAST({c.staging or "NULL"} AS {SQL_TYPES[type(c.type)]}) AS "{c.header}"'
        for c in _columns
    )
    VIEWS[_table] = f"SELECT {_select} FROM bind_{_table}"
for _table in RAW_TABLES:
    _select = ", ".join(
        f"CAST({c.staging} AS {SQL_TYPES[type(c.type)]}) AS {c.staging}"
        for c in staging_columns(_table)
    )
    _needed = REQUIRED_DESCRIPTION.get(_table)
    _where = f" WHERE {_needed} IS NOT NULL" if _needed else ""
    VIEWS[f"stg_{_table}"] = f"SELECT {_select} FROM bind_{_table}{_where}"

VIEWS["int_customer_policies"] = """
    SELECT codice_cliente, nome, cognome, eta, professione, reddito, stato_civile, agenzia,
        zona_residenza, engagement_score, churn_probability, clv_stimato, satisfaction_score,
        potenziale_crescita,
        count(DISTINCT p.prodotto) AS num_prodotti_distinti,
        greatest(count(p.codice_cliente), 1) AS num_polizze_totali,
        count(*) FILTER (WHERE p.stato_polizza = 'Attiva') AS num_polizze_attive,
        count(*) FILTER (WHERE p.stato_polizza = 'Scaduta') AS num_polizze_scadute,
        sum(p.premio_totale_annuo) AS premio_annuo_totale,
        sum(p.premio_totale_annuo) / count(p.premio_totale_annuo) AS premio_annuo_medio,
        sum(p.massimale) AS massimale_totale,
        CAST(sum(p.margine_lordo) AS BIGINT) AS margine_lordo_totale,
        avg(p.loss_ratio) AS loss_ratio_medio,
        count(*) FILTER (WHERE p.area_bisogno = 'Protezione') AS num_prodotti_protezione,
        count(*) FILTER (WHERE p.area_bisogno = 'Risparmio e Investimento')
            AS num_prodotti_investimento,
        count(*) FILTER (WHERE p.canale_acquisizione = 'Rete Diretta Agenziale')
            AS num_canale_agenziale,
        count(*) FILTER (WHERE p.canale_acquisizione = 'Online') AS num_canale_online
    FROM stg_clienti LEFT JOIN stg_polizze p USING (codice_cliente)
    GROUP BY ALL
"""
VIEWS["int_customer_claims"] = f"""
    SELECT *,
        CASE WHEN year(DATE '{AS_OF}') <> year(data_primo_sinistro)
            THEN CAST(num_sinistri_totali AS DOUBLE)
                / (year(DATE '{AS_OF}') - year(data_primo_sinistro)) END
            AS frequenza_sinistri_annua
    FROM (
        SELECT codice_cliente,
            count(*) AS num_sinistri_totali,
            count(DISTINCT prodotto) AS num_prodotti_con_sinistri,
            {counted('stato_liquidazione', models.CLAIM_STATES)},
            CAST(sum(importo_liquidato) AS BIGINT) AS importo_totale_liquidato,
            avg(importo_liquidato) AS importo_medio_liquidato,
            max(importo_liquidato) AS importo_max_liquidato,
            min(data_sinistro) AS data_primo_sinistro,
            max(data_sinistro) AS data_ultimo_sinistro
        FROM stg_sinistri GROUP BY codice_cliente
    )
"""
VIEWS["int_customer_interactions"] = f"""
    SELECT codice_cliente,
        count(*) AS num_interazioni_totali,
        count(DISTINCT tipo_interazione) AS num_tipi_interazione,
        {counted('tipo_interazione', models.INTERACTION_TYPES)},
        {counted('esito', models.OUTCOMES)},
        {counted('motivo', models.REASONS)},
        count(*) FILTER (WHERE conversione) AS num_conversioni,
        CAST(count(*) FILTER (WHERE conversione) AS DOUBLE) / count(*) AS tasso_conversione,
        avg(durata_minuti) AS durata_media_minuti,
        sum(durata_minuti) AS durata_totale_minuti,
        max(durata_minuti) AS durata_max_minuti,
        min(data_interazione) AS prima_interazione,
        max(data_interazione) AS ultima_interazione,
        CAST(max(data_interazione) - min(data_interazione) AS BIGINT) AS giorni_tra_prima_ultima
    FROM stg_interazioni_clienti GROUP BY codice_cliente
"""
VIEWS["dim_customers"] = """
    SELECT p.* EXCLUDE (num_polizze_scadute, loss_ratio_medio, num_canale_agenziale,
                        num_canale_online),
        ifnull(num_interazioni_totali, 0) AS num_interazioni_totali,
        ifnull(num_conversioni, 0) AS num_conversioni,
        ifnull(tasso_conversione, 0) AS tasso_conversione,
        ifnull(num_esiti_positivi, 0) AS num_esiti_positivi,
        ifnull(durata_media_minuti, 0) AS durata_media_interazioni,
        ifnull(s.num_sinistri_totali, 0) AS num_sinistri_totali,
        ifnull(s.importo_totale_liquidato, 0) AS importo_totale_liquidato,
        ifnull(s.frequenza_sinistri_annua, 0) AS frequenza_sinistri_annua,
        CASE
            WHEN p.clv_stimato > 50000 AND p.churn_probability IS NOT NULL
                THEN if(p.churn_probability < 0.3, 'Premium Loyal', 'Premium At Risk')
            WHEN p.churn_probability > 0.7 THEN 'High Churn Risk'
            WHEN p.potenziale_crescita > 0.5 THEN 'Growth Opportunity'
            WHEN p.num_polizze_attive = 0 THEN 'Inactive'
            ELSE 'Standard'
        END AS segmento_cliente,
        CASE
            WHEN s.num_sinistri_totali IS NULL THEN 'No Claims'
            WHEN s.frequenza_sinistri_annua >= 1.5 THEN 'High Risk'
            WHEN s.frequenza_sinistri_annua >= 0.5 THEN 'Medium Risk'
            ELSE 'Low Risk'
        END AS classificazione_rischio,
        CASE
            WHEN p.premio_annuo_totale <= 0 OR p.premio_annuo_totale IS NULL
                THEN 'No Active Policies'
            WHEN p.premio_annuo_totale <= 2000 THEN 'Low Value'
            WHEN p.premio_annuo_totale <= 5000 THEN 'Medium Value'
            ELSE 'High Value'
        END AS classificazione_valore
    FROM int_customer_policies p
    LEFT JOIN int_customer_interactions USING (codice_cliente)
    LEFT JOIN int_customer_claims s USING (codice_cliente)
"""
VIEWS["fact_policies"] = f"""
    SELECT p.*, c.nome, c.cognome, c.eta, c.professione, c.agenzia, c.zona_residenza,
        CAST(DATE '{AS_OF}' - p.data_emissione AS BIGINT) AS giorni_dalla_emissione,
        CAST(p.data_scadenza - DATE '{AS_OF}' AS BIGINT) AS giorni_alla_scadenza,
        CAST(ifnull(p.stato_polizza = 'Attiva', false) AS INTEGER) AS attiva,
        CAST(ifnull(p.data_scadenza < DATE '{AS_OF}', false) AS INTEGER) AS scaduta,
        CAST(ifnull(p.data_scadenza - DATE '{AS_OF}' BETWEEN 0 AND 90, false) AS INTEGER)
            AS in_scadenza,
        CASE
            WHEN p.margine_lordo <= 0 OR p.margine_lordo IS NULL THEN 'Negative Margin'
            WHEN p.margine_lordo <= 500 THEN 'Low Margin'
            WHEN p.margine_lordo <= 1000 THEN 'Medium Margin'
            ELSE 'High Margin'
        END AS fascia_profittabilita
    FROM stg_polizze p LEFT JOIN stg_clienti c USING (codice_cliente)
"""
VIEWS["market_rows"] = f"""
    SELECT '{COMPANY}' AS compagnia, area_bisogno AS tipo_prodotto,
        avg(premio_totale_annuo) AS premio_medio, avg(massimale) AS massimale_medio,
        CAST(NULL AS DOUBLE) AS rating_clienti, CAST(NULL AS DOUBLE) AS quota_mercato_perc,
        count(*) AS num_polizze, 'Internal' AS fonte
    FROM stg_polizze WHERE stato_polizza = 'Attiva' GROUP BY area_bisogno
    UNION ALL
    SELECT competitor, tipo_prodotto, CAST(premio_medio AS DOUBLE),
        CAST(massimale_medio AS DOUBLE), rating_clienti, quota_mercato_perc, NULL, 'Competitor'
    FROM stg_competitor_prodotti
"""
VIEWS["demographics"] = renamed("stg_clienti", extracts.DEMOGRAPHICS)
VIEWS["policies"] = renamed("stg_polizze", extracts.POLICY)
VIEWS["geography"] = renamed("stg_clienti", extracts.GEOGRAPHY) + (
    " WHERE latitudine IS NOT NULL AND longitudine IS NOT NULL"
)
# The customer selection the report queries use.
VIEWS["selected"] = """
    SELECT * FROM demographics
    WHERE age BETWEEN 25 AND 70 AND income BETWEEN 0 AND 8000 AND cluster = 'High_Responder'
"""
VIEWS["selected_policies"] = "SELECT * FROM policies WHERE customer_id IN (SELECT customer_id FROM selected)"
VIEWS["selected_geography"] = "SELECT * FROM geography WHERE customer_id IN (SELECT customer_id FROM selected)"
VIEWS["stages"] = """
    SELECT anzianita_compagnia AS tenure_years, engagement_score, churn_probability,
        num_polizze AS policy_count, visite_ultimo_anno AS annual_visits,
        CASE
            WHEN anzianita_compagnia IS NULL OR anzianita_compagnia >= 10 THEN 'Loyal (10y+)'
            WHEN anzianita_compagnia >= 5 THEN 'Mature (5-10y)'
            WHEN anzianita_compagnia >= 2 THEN 'Growing (2-5y)'
            ELSE 'New (0-2y)'
        END AS lifecycle_stage
    FROM stg_clienti WHERE engagement_score IS NOT NULL
"""
VIEWS["channels"] = """
    SELECT canale_acquisizione AS channel,
        count(DISTINCT codice_cliente) AS customer_count,
        avg(c.clv_stimato) AS avg_clv,
        avg(c.engagement_score) AS avg_engagement,
        avg(p.premio_totale_annuo) AS avg_premium,
        sum(p.premio_totale_annuo) AS total_revenue,
        CAST(sum(p.margine_lordo) AS BIGINT) AS total_margin
    FROM stg_polizze p JOIN stg_clienti c USING (codice_cliente)
    WHERE p.stato_polizza = 'Attiva' GROUP BY channel
"""
VIEWS["products"] = """
    SELECT prodotto AS product, area_bisogno AS need_area, avg(loss_ratio) AS avg_loss_ratio,
        sum(premio_totale_annuo) AS total_premium,
        CAST(sum(margine_lordo) AS BIGINT) AS total_margin, count(*) AS policy_count,
        avg(premio_totale_annuo) AS avg_premium
    FROM stg_polizze WHERE stato_polizza = 'Attiva' GROUP BY ALL
"""
VIEWS["contacts"] = """
    SELECT tipo_interazione AS interaction_type, count(*) AS interaction_count,
        avg(durata_minuti) AS avg_duration,
        CAST(count(*) FILTER (WHERE conversione) AS DOUBLE) / count(*) * 100 AS conversion_rate
    FROM stg_interazioni_clienti GROUP BY interaction_type
"""
_averages = ", ".join(
    f"round(avg({column}) * 1e6) / 1e6 AS {name}"
    for name, column in analyses.CLUSTER_AVERAGES.items()
)
VIEWS["clusters"] = f"""
    SELECT cluster_risposta AS cluster, count(*) AS customer_count, {_averages}
    FROM stg_clienti WHERE cluster_risposta IS NOT NULL GROUP BY cluster
"""
VIEWS["dated_claims"] = renamed("stg_sinistri", extracts.CLAIM) + " WHERE data_sinistro IS NOT NULL"


def with_views(select: str) -> str:
    """The SELECT with the views it needs, directly or through other views, in front of it."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        bare = re.sub(r'"[^"]*"|\'[^\']*\'', "", sql)
        for word in re.findall(r"(?:FROM|JOIN)\s+(\w+)", bare):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                needed.append(word)

    visit(select)
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {ctes}\n{select}"
