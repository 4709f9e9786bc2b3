"""Raw insurance tables derived from order-shaped source tables.

`BINDINGS` holds one SELECT per raw table, in the SQL that Spark and DuckDB share, with
`{customer}`-style places for the source tables. Columns carry staging names; `raw_table` turns
them into the headers of the delivered files.

Every source row has its place. Customers without policies and with few of them, and customers with
few claims, come from moving keys: their rows count for a customer nearby.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quaestor.schemas import RAW_TABLES

BINDINGS = {
    "clienti": """
        SELECT c_custkey AS codice_cliente, c_name AS nome, c_name AS cognome, n_name AS luogo_nascita,
          18 + c_custkey % 80 AS eta, n_name AS luogo_residenza, n_name AS zona_residenza,
          c_mktsegment AS professione,
          CASE WHEN c_custkey % 2 = 0 THEN 'Sposato' ELSE 'Single' END AS stato_civile,
          CAST(floor(c_acctbal) AS bigint) AS reddito,
          CAST(floor(c_acctbal * 10) AS bigint) AS clv_stimato,
          c_custkey % 25 AS anzianita_compagnia, c_custkey % 6 AS num_polizze, n_name AS agenzia,
          CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS double) END AS engagement_score,
          CAST(c_custkey % 100 AS double) / CAST(100 AS double) AS churn_probability,
          CAST(c_custkey % 32 AS double) / CAST(32 AS double) AS potenziale_crescita,
          CAST((c_custkey * 7) % 101 AS double) AS satisfaction_score,
          CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(36 + c_custkey % 11 AS double) END AS latitudine,
          CAST(7 + c_custkey % 12 AS double) AS longitudine,
          c_custkey % 13 AS visite_ultimo_anno,
          CAST(floor(c_acctbal * 2) AS bigint) AS reddito_familiare, CAST(floor(c_acctbal * 3) AS double) AS reddito_stimato,
          CAST(floor(c_acctbal * 4) AS double) AS patrimonio_finanziario, CAST(floor(c_acctbal * 5) AS double) AS patrimonio_reale,
          CAST(floor(c_acctbal / 2) AS double) AS consumi_stimati, c_custkey % 4 AS numero_figli, c_custkey % 5 AS numero_familiari_carico,
          c_custkey % 3 AS reclami_totali, CAST(c_custkey % 8 AS double) / CAST(8 AS double) AS propensione_vita,
          CAST(c_custkey % 16 AS double) / CAST(16 AS double) AS propensione_danni,
          CAST(1000 + c_custkey % 4000 AS double) AS valore_immobiliare_medio,
          CAST(c_custkey % 4 AS double) / CAST(4 AS double) AS probabilita_furti, CAST(c_custkey % 2 AS double) / CAST(2 AS double) AS probabilita_rapine,
          CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN DATE '2000-01-15' ELSE DATE '1999-07-01' END AS data_ultima_visita,
          CASE c_custkey % 4 WHEN 0 THEN 'High_Responder' WHEN 1 THEN 'Moderate_Responder' WHEN 2 THEN 'Low_Responder' END AS cluster_risposta
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    """,
    "polizze": """
        SELECT CASE WHEN o_custkey % 10 = 0 OR o_custkey % 5 = 1 AND o_orderkey % 8 <> 0 THEN o_custkey + 2
            ELSE o_custkey END AS codice_cliente, o_orderpriority AS prodotto,
          CASE o_orderkey % 3 WHEN 0 THEN 'Protezione' WHEN 1 THEN 'Risparmio e Investimento' ELSE 'Previdenza' END AS area_bisogno,
          CASE o_orderstatus WHEN 'O' THEN 'Attiva' WHEN 'F' THEN 'Scaduta' ELSE 'Sospesa' END AS stato_polizza,
          CASE WHEN o_orderkey % 2 = 0 THEN 'Rete Diretta Agenziale' ELSE 'Online' END AS canale_acquisizione,
          CAST(o_orderdate AS date) AS data_emissione,
          CAST(CAST(o_orderdate AS date) + INTERVAL '1' YEAR AS date) AS data_scadenza,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 400) AS double) END AS premio_totale_annuo,
          CAST(floor(o_totalprice) AS double) AS massimale,
          CAST(floor(o_totalprice / 300) AS bigint) - 200 AS margine_lordo,
          CAST(o_orderkey % 64 AS double) / CAST(32 AS double) AS loss_ratio,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice / 400) AS double) END AS premio_ricorrente,
          CASE WHEN o_orderkey % 2 = 1 THEN CAST(floor(o_totalprice / 10) AS double) END AS premio_unico,
          CASE WHEN o_orderkey % 3 = 1 THEN CAST(floor(o_totalprice / 8) AS double) END AS capitale_rivalutato,
          CAST(o_orderkey % 16 AS double) / CAST(64 AS double) AS commissione_perc, CAST(floor(o_totalprice / 4000) AS bigint) AS commissione_euro,
          CAST(floor(o_totalprice / 2000) AS double) AS costi_operativi,
          CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice / 5000) AS double) END AS importo_liquidato, o_orderkey % 4 AS sinistri_totali
        FROM {orders}
    """,
    "sinistri": """
        SELECT CASE WHEN l_quantity < 1 + (o_custkey % 20) THEN o_custkey WHEN o_custkey < 20 THEN 19
            ELSE o_custkey - o_custkey % 20 - 1 END AS codice_cliente, o_orderpriority AS prodotto,
          CASE o_orderkey % 3 WHEN 0 THEN 'Protezione' WHEN 1 THEN 'Risparmio e Investimento' ELSE 'Previdenza' END AS area_bisogno,
          CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS sinistro, CAST(l_shipdate AS date) AS data_sinistro,
          CAST(floor(l_extendedprice) AS bigint) AS importo_liquidato,
          CASE l_returnflag WHEN 'R' THEN 'Liquidato' WHEN 'A' THEN 'In Lavorazione' ELSE 'Respinto' END AS stato_liquidazione
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    """,
    "reclami": """
        SELECT o_custkey AS codice_cliente, o_orderpriority AS prodotto,
          CASE o_orderkey % 3 WHEN 0 THEN 'Protezione' WHEN 1 THEN 'Risparmio e Investimento' ELSE 'Previdenza' END AS area_bisogno,
          CASE WHEN o_orderkey % 7 <> 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'Reclamo' ELSE 'Info' END AS reclami_e_info
        FROM {orders}
    """,
    "interazioni_clienti": """
        SELECT user_id AS codice_cliente, CAST(ts AS date) AS data_interazione,
          CASE event_type WHEN 'view' THEN 'Chat Online' WHEN 'click' THEN 'App Mobile' WHEN 'signup' THEN 'Visita Agente' WHEN 'error' THEN 'Telefono' ELSE 'Email' END AS tipo_interazione,
          CASE event_id % 4 WHEN 0 THEN 'Consulenza' WHEN 1 THEN 'Reclamo' WHEN 2 THEN 'Pagamento Premio' ELSE 'Informazioni Prodotto' END AS motivo,
          CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS double) END AS durata_minuti,
          CASE event_id % 3 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Negativo' ELSE 'Neutrale' END AS esito,
          CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS note, event_id % 5 = 0 AS conversione
        FROM {events}
    """,
    "abitazioni": """
        SELECT c_custkey AS codice_cliente, n_name AS luogo_residenza,
          c_name AS indirizzo, 30 + (c_custkey * 13) % 270 AS metratura, c_custkey % 3 = 0 AS sistema_allarme
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    """,
    "competitor_prodotti": """
        SELECT p_brand AS competitor,
          CASE WHEN p_size % 2 = 0 THEN 'Protezione' ELSE 'Previdenza' END AS tipo_prodotto,
          CASE WHEN min(p_size) % 5 = 0 THEN NULL ELSE CAST(floor(max(p_retailprice)) AS double) END AS premio_medio,
          CAST(sum(p_size) AS double) * CAST(100 AS double) AS massimale_medio,
          CASE WHEN max(p_partkey) % 4 = 0 THEN NULL ELSE CAST(max(p_partkey) % 50 AS double) / CAST(10 AS double) END AS rating_clienti,
          CAST(count(*) AS double) AS quota_mercato_perc, CASE WHEN count(*) > 40 THEN 'Base' ELSE 'Intermedia' END AS coperture_extra
        FROM {part} GROUP BY p_brand, CASE WHEN p_size % 2 = 0 THEN 'Protezione' ELSE 'Previdenza' END
    """,
}

# Sources that a binding joins to a larger one: rows of the larger stream past a hash table of their
# partition's, so no task sorts either side.
HASHED = {"sinistri": "orders"}


def source_names(sql: str) -> list[str]:
    """Source tables a binding reads."""
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def raw_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One raw table over `<folder>/<source>.parquet`, under the headers of the delivered file."""
    sql = BINDINGS[table]
    sources = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in source_names(sql)}
    if hashed := HASHED.get(table):
        sources[hashed] = sources[hashed].hint("shuffle_hash")
    return spark.sql(sql, **sources).selectExpr(*[
        f"CAST({c.staging or 'NULL'} AS {c.type.simpleString()}) AS `{c.header}`"
        for c in RAW_TABLES[table]
    ])


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {table: raw_table(spark, folder, table) for table in BINDINGS}
