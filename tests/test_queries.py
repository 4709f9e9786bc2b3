"""Every query against its SQL on DuckDB, over whole tables."""

import pytest

import __spark_entry__ as entry_points
import compare
from conftest import TESTDATA
from quaestor.sources.binding import BINDINGS, raw_table
from quaestor.verification.oracles import oracle_sql
from quaestor.verification.queries import queries

FOLDER = str(TESTDATA / "sf0.001")
QUERIES = queries()
EXPECTED = oracle_sql()
SAMPLES = {"head_rows": 100, "geo_sample": 7000}


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(FOLDER)
    yield con
    con.close()


def test_every_query_but_the_samples_has_sql():
    assert set(QUERIES) - set(EXPECTED) == set(SAMPLES)
    assert set(EXPECTED) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, EXPECTED[name]) is None


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_samples_are_rows_of_the_table(spark, name):
    whole = "stg_clienti" if name == "head_rows" else "customer_geography"
    everything = QUERIES[whole](spark, FOLDER).count()
    assert QUERIES[name](spark, FOLDER).count() == min(SAMPLES[name], everything)


def test_entry_is_the_customer_dimension(spark):
    df = entry_points.entry(spark)
    assert "segmento_cliente" in df.columns and df.count() > 0


def test_checks_find_what_is_wrong_in_whole_tables(spark):
    failing = QUERIES["dq_claims_early"](spark, FOLDER).filter("status = 'fail'").collect()
    assert [(r.column_name, r.detail) for r in failing] == [("frequenza_sinistri_annua", "> 0")]


def test_entry_points_have_every_query_of_the_library():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(EXPECTED) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("table", ["clienti", "polizze", "sinistri", "reclami", "abitazioni", "interazioni_clienti"])
def test_every_source_row_is_bound(spark, duck, table):
    source = {"clienti": "customer", "polizze": "orders", "sinistri": "lineitem", "reclami": "orders",
              "abitazioni": "customer", "interazioni_clienti": "events"}[table]
    whole = duck.execute(f"SELECT count(*) FROM {source}").fetchall()[0][0]
    assert table in BINDINGS and raw_table(spark, FOLDER, table).count() == whole


@pytest.mark.parametrize("query, column, classes", [
    ("dim_customers", "segmento_cliente", 6),
    ("dim_customers", "classificazione_rischio", 4),
    ("dim_customers", "classificazione_valore", 4),
    ("fact_policies", "fascia_profittabilita", 4),
])
def test_every_class_occurs(spark, query, column, classes):
    assert QUERIES[query](spark, FOLDER).select(column).distinct().count() == classes
