"""Quantiles, boxes, histograms and densities against numpy on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

import samples
from quaestor.operators import distributions, profile, quantiles
from quaestor.operators.quantiles import exact_quantiles

PROBABILITIES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def frame(spark, values, groups=None):
    groups = groups or ["g"] * len(values)
    return spark.createDataFrame(
        [(g, None if v is None else float(v)) for g, v in zip(groups, values)], "g string, x double"
    )


def check_quantiles(df, values, **options):
    row = exact_quantiles(df, "x", PROBABILITIES, ["g"], **options).first()
    for name, p in PROBABILITIES.items():
        assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert row.n == len(values)


@pytest.mark.parametrize("few_groups", [True, False])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 10, 101, 1000])
def test_quantiles_of_small_groups(spark, size, few_groups):
    values = np.random.default_rng(size).normal(size=size)
    check_quantiles(frame(spark, values), values, few_groups=few_groups)


@hypothesis_settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.integers(-3, 3) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    check_quantiles(frame(spark, values), np.array(values, dtype=float))


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_of_many_rows_with_heavy_values_and_a_dominant_group(spark, few_groups):
    """More rows than the sketch keeps; a third of all rows hold one value of one group."""
    n = 600_000
    df = spark.range(n).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 'big' ELSE 'small' END AS g",
        "CASE WHEN id % 3 = 0 THEN 5.0D ELSE exp((id * 7919 % 600011) / 60000.0D) END AS x",
    )
    ids = np.arange(n)
    x = np.where(ids % 3 == 0, 5.0, np.exp((ids * 7919 % 600011) / 60000.0))
    got = {
        r.g: r for r in exact_quantiles(df, "x", PROBABILITIES, ["g"], few_groups=few_groups).collect()
    }
    for group, members in (("big", ids % 10 < 9), ("small", ids % 10 == 9)):
        for name, p in PROBABILITIES.items():
            assert got[group][name] == pytest.approx(np.quantile(x[members], p), rel=1e-9)


def test_quantiles_without_groups_leave_out_nulls(spark):
    row = exact_quantiles(frame(spark, [None, 1, 2, None, 4]), "x", {"m": 0.5}).first()
    assert (row.n, row.m) == (3, 2.0)


def box_by_hand(values):
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = values[(values >= low) & (values <= high)]
    return (len(values), q1, median, q3, min(inside.min(), q1), max(inside.max(), q3),
            int(((values < low) | (values > high)).sum()))


@pytest.mark.parametrize("values", [
    [0, 10, 10, 10], [1, 2, 3, 4, 100], [-50, 1, 2, 3, 4, 5], [7], [3, 3, 3, 3], [1, 2],
])
def test_box_summary(spark, values):
    df = frame(spark, values + [None], ["g"] * len(values) + ["g"])
    row = distributions.box_summary(df, "x", "g").first()
    got = (row.n, row.q1, row["median"], row.q3, row.whisker_low, row.whisker_high, row.outliers)
    assert got == pytest.approx(box_by_hand(np.array(values, dtype=float)))


def test_box_summary_leaves_out_unknown_groups(spark):
    df = frame(spark, [1, 2, 3], ["a", None, "a"])
    assert [r.g for r in distributions.box_summary(df, "x", "g").collect()] == ["a"]


@pytest.mark.parametrize("bins", [1, 3, 10, 30])
@pytest.mark.parametrize("values", [
    [1, 2, 2, 3, 10], [0.1 * i for i in range(101)], list(range(18, 98)), [5, 5, 5], [-1e9, 1e9, 0],
])
def test_histogram_is_numpys(spark, values, bins):
    counts, edges = np.histogram(np.array(values, dtype=float), bins=bins)
    rows = distributions.histogram(frame(spark, values + [None], None), "x", bins).orderBy("bin").collect()
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] + [rows[-1].bin_end] == pytest.approx(edges.tolist())


def test_profile_of_a_constant_column_is_that_of_its_sql(spark):
    import duckdb

    from quaestor.verification.oracles import _histogram

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES (7.5::DOUBLE, 1::BIGINT), (7.5, 4), (NULL, 9)) AS v(same, other)")
    df = spark.createDataFrame([(7.5, 1), (7.5, 4), (None, 9)], "same double, other long")
    rows = profile.profile_histograms({"t": df}, 5).orderBy("column_name", "bin").collect()
    got = [(r.column_name, r.bin, r.bin_start, r.bin_end, r.n) for r in rows]
    expected = [(c, *r) for c in ("other", "same") for r in con.execute(f"{_histogram('t', c, 5)} ORDER BY bin").fetchall()]
    assert got == expected
    assert [n for c, *_, n in got if c == "same"] == [0, 0, 0, 0, 2]


def test_log_histogram_drops_what_has_no_logarithm(spark):
    values = [0, -5, 1, 10, 100, 1000, None]
    rows = distributions.log_histogram(frame(spark, values), "x", 3).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 1, 2]
    assert rows[0].bin_start == 0.0 and rows[-1].bin_end == pytest.approx(3.0)


def density_by_hand(values, points, reach):
    h = np.std(values, ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - reach * h, values.max() + reach * h, points)
    k = np.exp(-0.5 * ((x[:, None] - values[None, :]) / h) ** 2).sum(axis=1)
    return x, k / (len(values) * h * math.sqrt(2 * math.pi))


def test_density_curve(spark):
    values = np.array([1, 1, 2, 3, 5, 8, 13], dtype=float)
    for points, reach in ((200, 0.0), (100, 2.0)):
        x, y = density_by_hand(values, points, reach)
        rows = distributions.density_curve(
            frame(spark, values), "x", ["g"], points, reach
        ).orderBy("point").collect()
        assert [r.x for r in rows] == pytest.approx(x.tolist())
        assert [r.density for r in rows] == pytest.approx(y.tolist())


def test_density_needs_spread(spark):
    df = frame(spark, [1, 1, 4], ["a", "a", "b"])
    assert distributions.density_curve(df, "x", ["g"]).count() == 0


def test_profiles_of_a_small_table(spark):
    rows = [("a", 1, 1.5), ("a", 1, 1.5), ("b", None, None), (None, 3, None), (None, 3, None)]
    df = spark.createDataFrame(rows, "word string, whole long, part double").selectExpr(
        "*", "DATE '2020-01-01' + CAST(coalesce(whole, 5) AS int) AS `some day`",
        "CAST(NULL AS double) AS nothing",
    )
    tables = {"t": df}
    columns = {r.column_name: r for r in profile.profile_columns(tables).collect()}
    assert (columns["word"].non_null_count, columns["word"].null_count) == (3, 2)
    assert columns["word"].null_pct == 40.0 and columns["some day"].data_type == "date"
    assert [r.column_name for r in profile.profile_nulls(tables).collect()] == [
        "nothing", "part", "word", "whole",
    ]
    numbers = {r.column_name: r for r in profile.profile_numeric(tables).collect()}
    described = pd.Series([1, 1, 3, 3]).describe()
    assert numbers["whole"]["count"] == 4 and numbers["whole"]["std"] == pytest.approx(described["std"])
    assert numbers["whole"].q25 == 1.0 and numbers["whole"].q50 == 2.0 and numbers["whole"]["max"] == 3
    assert numbers["nothing"]["count"] == 0 and numbers["nothing"]["mean"] is None
    word = profile.profile_categorical(tables).first()
    assert (word.distinct_values, word.most_common, word.most_common_count) == (2, "a", 2)
    assert word.most_common_pct == 40.0
    top = [(r.position, r.value, r.n) for r in profile.profile_top_values(tables, 1).collect()]
    assert top == [(1, "a", 2)]
    day = profile.profile_dates(tables).first()
    assert day.column_name == "some day" and day.range_days == 4
    whole = profile.profile_overview(tables).first()
    assert (whole.rows, whole.columns, whole.duplicate_rows) == (5, 5, 2)


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "word string, whole long")
    columns = profile.profile_columns({"t": df}).collect()
    assert [(r.null_count, r.null_pct) for r in columns] == [(0, None), (0, None)]
    assert profile.profile_overview({"t": df}).first().rows == 0
    assert profile.profile_dates({"t": df}).count() == 0
    flags = {"f": df.selectExpr("whole > 0 AS flag")}
    assert profile.profile_numeric(flags).count() == profile.profile_categorical(flags).count() == 0
    assert [r.n for r in distributions.histogram(df, "whole", 2).collect()] == [0, 0]


def test_profiles_take_raw_headers_as_they_are(spark):
    raw = samples.raw_frames(spark)
    for name, function in vars(profile).items():
        if name.startswith("profile_"):
            assert function(raw).count() > 0, name
    rows = distributions.histogram(raw["clienti"], "Età", 3).collect()
    assert sum(r.n for r in rows) == len(samples.CUSTOMERS)


def test_nan_counts_as_unknown(spark):
    df = frame(spark, [1.0, float("nan"), 3.0])
    row = exact_quantiles(df, "x", {"m": 0.5}).first()
    assert (row.n, row.m) == (2, 2.0)


@pytest.mark.parametrize("few_groups", [True, False])
@pytest.mark.parametrize("accuracy, cells", [(1_000, 2), (2, 4), (100, 1)])
def test_quantiles_do_not_depend_on_how_well_the_first_bounds_fit(
    spark, monkeypatch, few_groups, accuracy, cells
):
    """A sketch that is nearly useless, or misses the rank, and cells that hardly part values."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "REACH", 0.0)
    monkeypatch.setattr(quantiles, "CELLS", cells)
    values = np.exp(np.random.default_rng(7).normal(size=3_000) * 3)
    check_quantiles(frame(spark, values), values, few_groups=few_groups)


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_between_infinite_and_huge_values(spark, few_groups):
    values = [float("-inf"), -1.7e308, -1.0, 0.0, 1.0, 2.0, 3.0, 1.7e308, float("inf")]
    names = {f"p{i}": i / 8 for i in range(9)}
    row = exact_quantiles(frame(spark, values), "x", names, ["g"], few_groups=few_groups).first()
    assert [row[f"p{i}"] for i in range(9)] == values


def test_cells_never_fall_as_values_rise(spark):
    low, high = F.lit(-3.0), F.lit(1e16)
    values = sorted([-3.0, 1e16, *np.random.default_rng(2).uniform(-3, 1e16, 400), *np.linspace(-3, 3, 50)])
    cell = quantiles.cell_of(F.col("x"), low, quantiles.scale_of(low, high, 64), 64)
    df = frame(spark, values).select("x", cell.alias("cell"))
    cells = [r.cell for r in df.orderBy("x").collect()]
    assert cells == sorted(cells) and cells[0] == 0 and cells[-1] == 63
