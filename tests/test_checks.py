"""Every kind of check: its failures when one row is broken, and only its failures."""

from collections import Counter
from datetime import date

import pytest

import samples
from quaestor.operators import checks
from quaestor.operators.checks import (
    EXPRESSION, NOT_NULL, RANGE, RELATIONSHIP, UNIQUE, VALUES, Check,
)
from quaestor.plans.check_definitions import (
    CHECKS, INTERMEDIATE_CHECKS, MART_CHECKS, SOURCE_CHECKS, STAGING_CHECKS,
)
from quaestor.plans.pipeline import build_frames

CLEAN = [samples.customer(1), samples.customer(2)]


def failures(spark, definitions=CHECKS, **replaced):
    clean = {
        "clienti": CLEAN,
        "polizze": [samples.policy(1, 100.0), samples.policy(2, 5.0)],
        "sinistri": [samples.claim(1, date(2020, 1, 1))],
        "interazioni_clienti": [samples.contact(1, date(2024, 1, 1))],
    }
    raw = samples.raw_frames(spark, **{**clean, **replaced})
    tables = {**raw, **build_frames(raw, samples.COMPANY, samples.AS_OF)}
    report = checks.check_report(tables, definitions)
    return {
        (r.check_kind, r.table_name, r.column_name): (r.failures, r.status)
        for r in report.filter("failures > 0").collect()
    }


def test_all_declared_checks_are_there():
    layers = (SOURCE_CHECKS, STAGING_CHECKS, INTERMEDIATE_CHECKS, MART_CHECKS)
    assert [len(layer) for layer in layers] == [10, 15, 102, 5]
    assert Counter(c.kind for c in CHECKS) == {
        NOT_NULL: 52, UNIQUE: 6, RELATIONSHIP: 12, RANGE: 6, VALUES: 1, EXPRESSION: 55,
    }
    assert sum(c.severity == "warn" for c in CHECKS) == 4
    assert len(set(CHECKS)) == len(CHECKS) == 132


def test_clean_tables_pass(spark):
    assert failures(spark) == {}


def test_missing_value(spark):
    assert failures(spark, clienti=[samples.customer(1, eta=None), samples.customer(2)]) == {
        (NOT_NULL, "clienti", "Età"): (1, "fail"),
        (NOT_NULL, "stg_clienti", "eta"): (1, "fail"),
        (NOT_NULL, "int_customer_policies", "eta"): (1, "fail"),
    }


def test_repeated_key(spark):
    doubled = [*CLEAN, samples.customer(2, nome="other")]
    assert failures(spark, clienti=doubled) == {
        (UNIQUE, "clienti", "codice_cliente"): (1, "fail"),
        (UNIQUE, "stg_clienti", "codice_cliente"): (1, "fail"),
        (UNIQUE, "int_customer_policies", "codice_cliente"): (1, "fail"),
        (UNIQUE, "dim_customers", "codice_cliente"): (1, "fail"),
    }


def test_orphans_count_rows_and_unknown_keys_do_not(spark):
    orphans = [samples.policy(1, 1.0), samples.policy(7, 1.0), samples.policy(7, 2.0)]
    assert failures(spark, polizze=orphans) == {
        (RELATIONSHIP, t, "codice_cliente"): (2, "fail")
        for t in ("polizze", "stg_polizze", "fact_policies")
    }
    unknown = [samples.claim(1, date(2020, 1, 1)), samples.claim(None, date(2020, 1, 1))]
    assert failures(spark, sinistri=unknown) == {
        (NOT_NULL, "int_customer_claims", "codice_cliente"): (1, "fail"),
    }


@pytest.mark.parametrize("eta, failing", [(17, 1), (18, 0), (100, 0), (101, 1)])
def test_range_is_inclusive(spark, eta, failing):
    got = failures(spark, STAGING_CHECKS, clienti=[samples.customer(1, eta=eta), samples.customer(2)])
    assert got == ({(RANGE, "stg_clienti", "eta"): (1, "fail")} if failing else {})


def test_value_outside_the_list_counts_once(spark):
    df = spark.createDataFrame([("a",), ("x",), ("x",), ("y",), (None,)], "c string")
    line = checks.value_checks({"t": df}, [Check(VALUES, "t", "c", values=("a", "it's"))]).first()
    assert (line.failures, line.status, line.detail) == (2, "fail", "a, it's")


def test_expression_is_one_condition_and_null_passes(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 2), (-1, None)], "a int, b int")
    either = Check(EXPRESSION, "t", "a", expression="> 0 OR b IS NULL")
    bounded = Check(EXPRESSION, "t", "a", expression="<= b", severity="warn")
    lines = checks.row_checks({"t": df}, [either, bounded]).collect()
    assert [(r.failures, r.status) for r in lines] == [(0, "pass"), (1, "warn")]
