"""From delivered files to saved marts and the check report."""

import pytest

import samples
from quaestor.plans.pipeline import MARTS, build_frames, run_pipeline
from quaestor.plans.report import report
from quaestor.operators.extracts import CustomerFilter
from quaestor.sources.csv_tables import load_csv_tables
from quaestor.sources.tables import LOAD_TIME_COLUMN, read_raw_tables


@pytest.fixture
def database(spark):
    name = "insurance"
    yield name
    for suffix in ("", "_marts"):
        spark.sql(f"DROP DATABASE IF EXISTS {name}{suffix} CASCADE")


@pytest.mark.parametrize("buckets", [None, 4])
def test_files_to_marts(spark, tmp_path, database, buckets):
    samples.write_csv(tmp_path)
    load_csv_tables(
        spark, str(tmp_path), database,
        bucket_column="codice_cliente" if buckets else None, buckets=buckets,
    )
    raw = read_raw_tables(spark, database)
    assert len(raw) == 7
    for _ in range(2):  # the second run rewrites the tables
        lines = run_pipeline(
            spark, raw, samples.COMPANY, database, samples.AS_OF, customer_buckets=buckets
        )
    expected = build_frames(samples.raw_frames(spark), samples.COMPANY, samples.AS_OF)
    for mart in MARTS:
        saved = spark.table(f"{database}_marts.{mart}")
        assert (LOAD_TIME_COLUMN in saved.columns) == (mart != "mart_competitor_analysis")
        got = saved.drop(LOAD_TIME_COLUMN).collect()
        assert sorted(map(str, got)) == sorted(map(str, expected[mart].collect()))
    assert lines.count() == 132
    failing = {(r.check_kind, r.table_name) for r in lines.filter("status = 'fail'").collect()}
    assert failing == {
        ("relationships", "polizze"), ("relationships", "stg_polizze"),
        ("relationships", "fact_policies"),
    }
    assert spark.sql("SELECT count(*) FROM int_customer_claims").first()[0] == 5


def test_a_failing_check_leaves_the_former_marts(spark, database):
    clean = {
        "clienti": [samples.customer(1), samples.customer(2)], "polizze": [samples.policy(1, 100.0)],
        "sinistri": [], "interazioni_clienti": [],
    }

    def run(**changes):
        raw = samples.raw_frames(spark, **{**clean, **changes})
        report = run_pipeline(spark, raw, samples.COMPANY, database, samples.AS_OF, only_if_passing=True)
        tables = {t.name for t in spark.catalog.listTables(f"{database}_marts") if not t.isTemporary}
        assert tables == {*MARTS, "check_report"}
        customers = {r.codice_cliente for r in spark.table(f"{database}_marts.dim_customers").collect()}
        return customers, report.filter("status = 'fail'").count()

    assert run() == ({1, 2}, 0)
    customers, failing = run(clienti=[*clean["clienti"], samples.customer(3, eta=None)])
    assert customers == {1, 2} and failing > 0
    assert run(clienti=[*clean["clienti"], samples.customer(3)]) == ({1, 2, 3}, 0)


def test_no_marts_appear_if_the_first_run_fails(spark, database):
    raw = samples.raw_frames(spark, clienti=[samples.customer(1, eta=None)])
    run_pipeline(spark, raw, samples.COMPANY, database, samples.AS_OF, only_if_passing=True)
    assert [t.name for t in spark.catalog.listTables(f"{database}_marts") if not t.isTemporary] == ["check_report"]


def test_report_frames_follow_the_selection(spark):
    staged = {n: f for n, f in build_frames(samples.raw_frames(spark), "x").items()
              if n.startswith("stg_")}
    with report(staged, CustomerFilter(income=(0, None))) as pages:
        assert pages["kpi_customers"].first().total_customers == len(samples.CUSTOMERS)
        assert pages["kpi_policies"].first().total_policies == len(samples.POLICIES) - 1
        for frame in pages.values():
            frame.collect()
    with report(staged, CustomerFilter(age=(41, None))) as pages:
        assert pages["kpi_customers"].first().total_customers == 0
        assert pages["kpi_policies"].first().total_premium == 0
        assert pages["kpi_products"].first().products == 2
