"""Raw table layouts: file header, staging name and Spark type of every column."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
DATE, BOOLEAN = T.DateType(), T.BooleanType()


class RawColumn(NamedTuple):
    header: str
    staging: str | None  # None: the column is not carried into staging
    type: T.DataType


# The headers of the delivered files, in file order, and their staging names.
RAW_TABLES: dict[str, tuple[RawColumn, ...]] = {
    "clienti": (
        RawColumn("Nome", "nome", STRING),
        RawColumn("Cognome", "cognome", STRING),
        RawColumn("Età", "eta", LONG),
        RawColumn("Luogo di Nascita", "luogo_nascita", STRING),
        RawColumn("Luogo di Residenza", "luogo_residenza", STRING),
        RawColumn("Professione", "professione", STRING),
        RawColumn("Reddito", "reddito", LONG),
        RawColumn("Reddito Familiare", "reddito_familiare", LONG),
        RawColumn("Numero Figli", "numero_figli", LONG),
        RawColumn("Anzianità con la Compagnia", "anzianita_compagnia", LONG),
        RawColumn("Stato Civile", "stato_civile", STRING),
        RawColumn("Numero Familiari a Carico", "numero_familiari_carico", LONG),
        RawColumn("Reddito Stimato", "reddito_stimato", DOUBLE),
        RawColumn("Patrimonio Finanziario Stimato", "patrimonio_finanziario", DOUBLE),
        RawColumn("Patrimonio Reale Stimato", "patrimonio_reale", DOUBLE),
        RawColumn("Consumi Stimati", "consumi_stimati", DOUBLE),
        RawColumn("Propensione Acquisto Prodotti Vita", "propensione_vita", DOUBLE),
        RawColumn("Propensione Acquisto Prodotti Danni", "propensione_danni", DOUBLE),
        RawColumn("Valore Immobiliare Medio", "valore_immobiliare_medio", DOUBLE),
        RawColumn("Probabilità Furti Stimata", "probabilita_furti", DOUBLE),
        RawColumn("Probabilità Rapine Stimata", "probabilita_rapine", DOUBLE),
        RawColumn("Zona di Residenza", "zona_residenza", STRING),
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Agenzia", "agenzia", STRING),
        RawColumn("Latitudine", "latitudine", DOUBLE),
        RawColumn("Longitudine", "longitudine", DOUBLE),
        RawColumn("Num_Polizze", "num_polizze", LONG),
        RawColumn("Engagement_Score", "engagement_score", DOUBLE),
        RawColumn("Churn_Probability", "churn_probability", DOUBLE),
        RawColumn("CLV_Stimato", "clv_stimato", LONG),
        RawColumn("Potenziale_Crescita", "potenziale_crescita", DOUBLE),
        RawColumn("Reclami_Totali", "reclami_totali", LONG),
        RawColumn("Satisfaction_Score", "satisfaction_score", DOUBLE),
        RawColumn("Data_Ultima_Visita", "data_ultima_visita", DATE),
        RawColumn("Visite_Ultimo_Anno", "visite_ultimo_anno", LONG),
        RawColumn("Cluster_Risposta", "cluster_risposta", STRING),
    ),
    "polizze": (
        RawColumn("Unnamed: 0", None, DOUBLE),
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Prodotto", "prodotto", STRING),
        RawColumn("Area di Bisogno", "area_bisogno", STRING),
        RawColumn("Data di Emissione", "data_emissione", DATE),
        RawColumn("Premio_Ricorrente", "premio_ricorrente", DOUBLE),
        RawColumn("Premio_Unico", "premio_unico", DOUBLE),
        RawColumn("Capitale_Rivalutato", "capitale_rivalutato", DOUBLE),
        RawColumn("Massimale", "massimale", DOUBLE),
        RawColumn("Stato_Polizza", "stato_polizza", STRING),
        RawColumn("Data_Scadenza", "data_scadenza", DATE),
        RawColumn("Canale_Acquisizione", "canale_acquisizione", STRING),
        RawColumn("Commissione_Perc", "commissione_perc", DOUBLE),
        RawColumn("Premio_Totale_Annuo", "premio_totale_annuo", DOUBLE),
        RawColumn("Commissione_Euro", "commissione_euro", LONG),
        RawColumn("Costi_Operativi", "costi_operativi", DOUBLE),
        RawColumn("Margine_Lordo", "margine_lordo", LONG),
        RawColumn("Importo_Liquidato", "importo_liquidato", DOUBLE),
        RawColumn("Sinistri_Totali", "sinistri_totali", LONG),
        RawColumn("Loss_Ratio", "loss_ratio", DOUBLE),
    ),
    "sinistri": (
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Prodotto", "prodotto", STRING),
        RawColumn("Area di Bisogno", "area_bisogno", STRING),
        RawColumn("Sinistro", "sinistro", STRING),
        RawColumn("Data_Sinistro", "data_sinistro", DATE),
        RawColumn("Importo_Liquidato", "importo_liquidato", LONG),
        RawColumn("Stato_Liquidazione", "stato_liquidazione", STRING),
    ),
    "reclami": (
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Prodotto", "prodotto", STRING),
        RawColumn("Area di Bisogno", "area_bisogno", STRING),
        RawColumn("Reclami_e_info", "reclami_e_info", STRING),
    ),
    "abitazioni": (
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Luogo di Residenza", "luogo_residenza", STRING),
        RawColumn("Indirizzo", "indirizzo", STRING),
        RawColumn("Metratura", "metratura", LONG),
        RawColumn("Sistema_Allarme", "sistema_allarme", BOOLEAN),
    ),
    "interazioni_clienti": (
        RawColumn("codice_cliente", "codice_cliente", LONG),
        RawColumn("Data_Interazione", "data_interazione", DATE),
        RawColumn("Tipo_Interazione", "tipo_interazione", STRING),
        RawColumn("Motivo", "motivo", STRING),
        RawColumn("Durata_Minuti", "durata_minuti", DOUBLE),
        RawColumn("Esito", "esito", STRING),
        RawColumn("Note", "note", STRING),
        RawColumn("Conversione", "conversione", BOOLEAN),
    ),
    "competitor_prodotti": (
        RawColumn("Competitor", "competitor", STRING),
        RawColumn("Tipo_Prodotto", "tipo_prodotto", STRING),
        RawColumn("Premio_Medio", "premio_medio", LONG),
        RawColumn("Massimale_Medio", "massimale_medio", LONG),
        RawColumn("Rating_Clienti", "rating_clienti", DOUBLE),
        RawColumn("Quota_Mercato_Perc", "quota_mercato_perc", DOUBLE),
        RawColumn("Coperture_Extra", "coperture_extra", STRING),
    ),
}

# The key that links every table but competitor_prodotti.
CUSTOMER_KEY = "codice_cliente"


def raw_schema(table: str) -> T.StructType:
    """Schema of a raw file; every column is nullable."""
    return T.StructType([T.StructField(c.header, c.type, True) for c in RAW_TABLES[table]])


def staging_columns(table: str) -> list[RawColumn]:
    """The columns a staging frame carries, in file order."""
    return [c for c in RAW_TABLES[table] if c.staging is not None]
