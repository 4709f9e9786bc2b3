"""Models over hand-made rows with literal results."""

from datetime import date

import pytest

import samples
from quaestor.plans import analyses
from quaestor.plans.pipeline import build_frames


@pytest.fixture(scope="module")
def frames(spark):
    return build_frames(samples.raw_frames(spark), samples.COMPANY, samples.AS_OF)


def by_key(df, key="codice_cliente"):
    return {row[key]: row.asDict() for row in df.collect()}


def test_staging_drops_rows_without_description(frames):
    assert frames["stg_sinistri"].count() == len(samples.CLAIMS) - 1
    assert frames["stg_reclami"].count() == 1
    assert "Unnamed: 0" not in frames["stg_polizze"].columns
    assert len(frames["stg_clienti"].columns) == 36
    assert len(frames["stg_polizze"].columns) == 19


def test_customer_without_policies_counts_one_and_has_no_amounts(frames):
    got = by_key(frames["int_customer_policies"])
    assert got[6]["num_polizze_totali"] == 1
    assert got[6]["num_polizze_attive"] == 0 and got[6]["num_prodotti_distinti"] == 0
    assert got[6]["premio_annuo_totale"] is None and got[6]["loss_ratio_medio"] is None
    assert got[5]["num_polizze_totali"] == 1 and got[5]["premio_annuo_totale"] is None
    assert 99 not in got


def test_policy_totals(frames):
    two = by_key(frames["int_customer_policies"])[2]
    assert two["num_prodotti_distinti"] == 2 and two["num_polizze_totali"] == 2
    assert two["premio_annuo_totale"] == 5000.5 and two["premio_annuo_medio"] == 2500.25
    assert two["margine_lordo_totale"] == 1501 and two["massimale_totale"] == 2000.0
    assert two["num_prodotti_protezione"] == 1 and two["num_prodotti_investimento"] == 1
    assert two["num_canale_agenziale"] == 1 and two["num_canale_online"] == 1


def test_equal_customer_rows_merge_and_add_up(spark):
    """The same as grouping the rows of the outer join by the whole profile."""
    raw = samples.raw_frames(
        spark,
        clienti=[samples.customer(1), samples.customer(1), samples.customer(1, eta=41),
                 samples.customer(None), samples.customer(None)],
        polizze=[samples.policy(1, 10.0), samples.policy(1, 30.0), samples.policy(None, 5.0)],
    )
    frames = build_frames(raw, samples.COMPANY, samples.AS_OF)
    got = {
        (r.codice_cliente, r.eta): (r.num_polizze_totali, r.premio_annuo_totale, r.premio_annuo_medio)
        for r in frames["int_customer_policies"].collect()
    }
    assert got == {
        (1, 40): (4, 80.0, 20.0), (1, 41): (2, 40.0, 20.0), (None, 40): (2, None, None),
    }


def test_claim_frequency_counts_year_boundaries(frames):
    got = by_key(frames["int_customer_claims"])
    assert {k: v["frequenza_sinistri_annua"] for k, v in got.items()} == {
        1: 1.0, 2: 0.5, 3: 1.5, 4: None, 5: 0.2,
    }
    assert got[5]["num_sinistri_respinti"] == 1 and got[5]["num_sinistri_liquidati"] == 0


def test_interactions(frames):
    got = by_key(frames["int_customer_interactions"])
    one, two = got[1], got[2]
    assert one["num_interazioni_totali"] == 3 and one["num_tipi_interazione"] == 2
    assert one["num_telefonate"] == 2 and one["num_email"] == 1 and one["num_app_mobile"] == 0
    assert one["tasso_conversione"] == pytest.approx(1 / 3)
    assert one["durata_media_minuti"] == 15.0 and one["durata_totale_minuti"] == 30.0
    assert one["giorni_tra_prima_ultima"] == 10
    assert two["num_conversioni"] == 0 and two["tasso_conversione"] == 0.0
    assert two["durata_media_minuti"] is None and two["num_consulenza"] == 1


def test_classes_at_their_edges(frames):
    got = by_key(frames["dim_customers"])
    assert {k: v["segmento_cliente"] for k, v in got.items()} == {
        1: "Standard", 2: "Premium At Risk", 3: "Premium Loyal", 4: "High Churn Risk",
        5: "Growth Opportunity", 6: "Inactive",
    }
    assert {k: v["classificazione_rischio"] for k, v in got.items()} == {
        1: "Medium Risk", 2: "Medium Risk", 3: "High Risk", 4: "Low Risk", 5: "Low Risk",
        6: "No Claims",
    }
    assert {k: v["classificazione_valore"] for k, v in got.items()} == {
        1: "Medium Value", 2: "High Value", 3: "Low Value", 4: "No Active Policies",
        5: "No Active Policies", 6: "No Active Policies",
    }
    assert got[6]["num_interazioni_totali"] == 0 and got[6]["frequenza_sinistri_annua"] == 0
    assert len(frames["dim_customers"].columns) == 34


def test_policy_facts(frames):
    rows = frames["fact_policies"].collect()
    assert len(rows) == len(samples.POLICIES)
    got = {(r.codice_cliente, r.prodotto): r for r in rows}
    band = {k: r.fascia_profittabilita for k, r in got.items()}
    assert band[1, "Casa"] == "Medium Margin" and band[2, "Casa"] == "High Margin"
    assert band[2, "Vita"] == "Low Margin" and band[3, "Casa"] == "Medium Margin"
    assert band[4, "Casa"] == "Negative Margin" and band[5, "Casa"] == "Negative Margin"
    expiring = {k: r.in_scadenza for k, r in got.items()}
    assert expiring[1, "Casa"] == 1 and expiring[2, "Casa"] == 1  # as-of day and 90 days later
    assert expiring[2, "Vita"] == 0 and expiring[3, "Casa"] == 0 and expiring[5, "Casa"] == 0
    assert got[3, "Casa"].scaduta == 1 and got[1, "Casa"].scaduta == 0
    assert got[1, "Casa"].giorni_alla_scadenza == 0 and got[3, "Casa"].giorni_alla_scadenza == -1
    assert got[1, "Casa"].giorni_dalla_emissione == 1827
    assert got[99, "Casa"].nome is None and got[4, "Casa"].attiva == 0


def test_market_ranks_put_nulls_last_and_leave_gaps(frames):
    got = {r.compagnia: r for r in frames["mart_competitor_analysis"].collect()
           if r.tipo_prodotto == "Casa"}
    assert {k: r.rank_premio for k, r in got.items()} == {
        "Uno": 1, "Due": 1, "Quattro": 3, "Tre": 4,
    }
    assert {k: r.rank_copertura for k, r in got.items()} == {
        "Due": 1, "Quattro": 2, "Uno": 3, "Tre": 4,
    }
    assert {k: r.rank_rating for k, r in got.items()} == {
        "Tre": 1, "Uno": 2, "Quattro": 2, "Due": 4,
    }
    own = [r for r in frames["mart_competitor_analysis"].collect() if r.fonte == "Internal"]
    assert {(r.compagnia, r.tipo_prodotto, r.num_polizze) for r in own} == {
        (samples.COMPANY, "Protezione", 5), (samples.COMPANY, "Risparmio e Investimento", 1),
    }


def test_current_date_is_the_default(spark):
    frames = build_frames(samples.raw_frames(spark), "x")
    facts = frames["fact_policies"].filter("giorni_alla_scadenza IS NOT NULL")
    off = facts.filter("giorni_alla_scadenza <> datediff(data_scadenza, current_date())")
    assert facts.count() == len(samples.POLICIES) - 1 and off.count() == 0


def test_channel_performance_weighs_by_policy(spark):
    raw = samples.raw_frames(
        spark,
        clienti=[samples.customer(1, clv_stimato=100), samples.customer(2, clv_stimato=400),
                 samples.customer(3, engagement_score=None, clv_stimato=None)],
        polizze=[samples.policy(1, 10.0), samples.policy(1, 20.0), samples.policy(2, None),
                 samples.policy(3, 60.0), samples.policy(4, 1000.0),
                 samples.policy(2, 1.0, stato_polizza="Scaduta")],
    )
    frames = build_frames(raw, "x")
    row = analyses.channel_performance(frames["stg_polizze"], frames["stg_clienti"]).first()
    assert row.channel == "Online" and row.customer_count == 3
    assert row.avg_clv == 200.0 and row.avg_engagement == 50.0
    assert row.avg_premium == 30.0 and row.total_revenue == 90.0 and row.total_margin == 40


def test_empty_months_are_zero(spark):
    raw = samples.raw_frames(spark, sinistri=[
        samples.claim(1, date(2024, 1, 31)), samples.claim(1, date(2024, 3, 1)),
        samples.claim(1, date(2024, 3, 2)), samples.claim(1, None),
    ])
    got = analyses.monthly_claims(build_frames(raw, "x")["stg_sinistri"]).collect()
    assert [tuple(r) for r in got] == [
        (date(2024, 1, 31), 1), (date(2024, 2, 29), 0), (date(2024, 3, 31), 2),
    ]
