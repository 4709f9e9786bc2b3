"""The physical plans that carry the work at scale."""

import re

import pytest

import samples
from conftest import TESTDATA
from quaestor.operators import distributions, profile, quantiles
from quaestor.operators.quantiles import exact_quantiles
from quaestor.operators.staging import stage, stage_all
from quaestor.plans import analyses, models
from quaestor.sources.binding import raw_table
from quaestor.sources.tables import save_table
from quaestor.verification.queries import queries

FOLDER = str(TESTDATA / "sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.fixture
def joins_stay_shuffled(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """Staging frames over saved tables, plain and bucketed by customer."""
    folder = tmp_path_factory.mktemp("saved")
    frames = {}
    for layout in ("plain", "bucketed"):
        raw = {}
        for table, df in samples.raw_frames(spark).items():
            keyed = layout == "bucketed" and "codice_cliente" in df.columns
            save_table(
                df, f"{layout}_{table}", path=f"{folder}/{layout}_{table}",
                bucket_column="codice_cliente" if keyed else None, buckets=4 if keyed else None,
            )
            raw[table] = spark.table(f"{layout}_{table}")
        frames[layout] = stage_all(raw)
    yield frames
    for layout in frames:
        for table in samples.ROWS:
            spark.sql(f"DROP TABLE {layout}_{table}")


def dimension(staged):
    return models.dim_customers(
        models.int_customer_policies(staged["stg_clienti"], staged["stg_polizze"]),
        models.int_customer_interactions(staged["stg_interazioni_clienti"]),
        models.int_customer_claims(staged["stg_sinistri"], samples.AS_OF),
    )


def test_no_query_runs_python_or_multiplies_rows(spark):
    for name, query in queries().items():
        plan = plan_of(query(spark, FOLDER))
        for word in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_customer_dimension_shuffles_each_fact_only_to_group_it(joins_stay_shuffled, saved):
    """Interactions and claims once, policies once more for distinct products, customers once to
    merge copies and once for the joins; the second and third join add no shuffle."""
    plan = plan_of(dimension(saved["plain"]))
    assert plan.count("Exchange hashpartitioning") == 6
    assert plan.count("SortMergeJoin") == 3


def test_bucketed_tables_need_one_shuffle_for_distinct_products_only(joins_stay_shuffled, saved):
    plan = plan_of(dimension(saved["bucketed"]))
    shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)", plan)
    assert plan.count("Exchange hashpartitioning") <= 1
    assert all(first == "codice_cliente" for first, _ in shuffles)


def test_scans_read_only_the_columns_used_and_take_the_filters(saved, settings):
    settings(spark__sql__maxMetadataStringLength="10000")
    plan = plan_of(analyses.product_performance(saved["plain"]["stg_polizze"]))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == [
        "Area di Bisogno", "Loss_Ratio", "Margine_Lordo", "Premio_Totale_Annuo", "Prodotto",
        "Stato_Polizza",
    ]
    assert "EqualTo(Stato_Polizza,Attiva)" in plan


def test_channel_join_sees_one_row_per_customer_and_channel(spark, joins_stay_shuffled, saved):
    staged = saved["plain"]
    plan = plan_of(analyses.channel_performance(staged["stg_polizze"], staged["stg_clienti"]))
    below_join = plan.split("SortMergeJoin")[1]
    assert below_join.count("HashAggregate") >= 4


def test_a_customer_with_most_policies_is_split_over_tasks(spark, joins_stay_shuffled, settings):
    settings(
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__shuffle__partitions="8",
    )
    raw = samples.raw_frames(spark)
    clienti = stage("clienti", raw["clienti"])
    rows = 40_000
    polizze = spark.range(0, rows, 1, 8).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 1 ELSE id % 2000 END AS codice_cliente",
        "concat('P', id % 97) AS prodotto", "'Protezione' AS area_bisogno",
        "'Attiva' AS stato_polizza", "'Online' AS canale_acquisizione",
        "DATE '2020-01-01' AS data_emissione", "DATE '2030-01-01' AS data_scadenza",
        *[f"CAST(id AS double) AS {c}" for c in (
            "premio_ricorrente", "premio_unico", "capitale_rivalutato", "massimale",
            "commissione_perc", "premio_totale_annuo", "costi_operativi", "importo_liquidato",
            "loss_ratio")],
        *[f"id AS {c}" for c in ("commissione_euro", "margine_lordo", "sinistri_totali")],
    )
    facts = models.fact_policies(polizze, clienti, samples.AS_OF)
    assert "skew=true" in final_plan(facts)
    assert facts.count() == rows

    totals = models.int_customer_policies(clienti, polizze)
    assert "skew=true" not in final_plan(totals)  # grouped first, so nothing is skewed
    one = totals.filter("codice_cliente = 1").first()
    assert one.num_polizze_totali == polizze.filter("codice_cliente = 1").count()


def test_policy_facts_are_joined_without_a_sort(joins_stay_shuffled, saved):
    plan = plan_of(models.fact_policies(saved["plain"]["stg_polizze"], saved["plain"]["stg_clienti"], samples.AS_OF))
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan
    assert "Sort" not in plan


def test_claims_are_bound_without_a_sort(spark, joins_stay_shuffled):
    plan = plan_of(raw_table(spark, FOLDER, "sinistri"))
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan
    assert "Sort" not in plan


def test_top_values_are_cut_before_the_shuffle(saved):
    plan = plan_of(profile.profile_top_values({"t": saved["plain"]["stg_polizze"]}))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_row_checks_read_each_table_once_without_a_shuffle_of_rows(spark, saved):
    from quaestor.operators import checks
    from quaestor.plans.check_definitions import STAGING_CHECKS

    plan = plan_of(checks.row_checks(saved["plain"], STAGING_CHECKS))
    assert plan.count("FileScan") == 3 and "hashpartitioning" not in plan


def test_numeric_profile_reads_again_only_what_the_first_counts_leave_open(saved):
    """Two reads: the bounds, and the counts in cells. What later rounds would read is left out when
    every rank is known by then. Values leave their task as counts only."""
    df = profile.profile_numeric({"t": saved["plain"]["stg_polizze"]})
    plan = final_plan(df)
    assert plan.count("FileScan") == 2
    assert "SortMergeJoin" not in plan
    assert all(", v#" not in keys for keys in re.findall(r"hashpartitioning\((.*?)\)", plan))


def test_check_report_evaluates_each_table_once(saved):
    from quaestor.operators import checks
    from quaestor.plans.check_definitions import STAGING_CHECKS

    plan = plan_of(checks.check_report(saved["plain"], STAGING_CHECKS))
    assert plan.count("FileScan") == len({c.table for c in STAGING_CHECKS}) == 4
    assert plan.count("Exchange hashpartitioning") == 1


def test_missing_values_are_filtered_by_the_scan(saved, settings):
    from quaestor.operators.extracts import customer_geography

    settings(spark__sql__maxMetadataStringLength="10000")
    plan = plan_of(customer_geography(saved["plain"]["stg_clienti"]))
    assert "IsNotNull(Latitudine)" in plan and "IsNotNull(Longitudine)" in plan
    plan = plan_of(distributions.density_curve(saved["plain"]["stg_clienti"], "reddito"))
    assert "IsNotNull(Reddito)" in plan


def test_histogram_evaluates_its_bounds_once(saved):
    df = distributions.histogram(saved["plain"]["stg_clienti"], "reddito", 30)
    assert final_plan(df).count("ReusedSubquery") > 0
    assert samples.CUSTOMERS and df.agg({"n": "sum"}).first()[0] == len(samples.CUSTOMERS)


@pytest.mark.parametrize("few_groups", [True, False])
def test_what_is_ranked_does_not_grow_with_the_group(spark, settings, few_groups):
    """Distinct values of one group, evenly spread or over many powers of ten."""
    settings(spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    ranked = {}
    for n in (40_000, 800_000):
        for shape in ("CAST(id * 7919 % 1000003 AS double)", "exp(CAST(id * 7919 % 1000003 AS double) / 40000)"):
            df = spark.range(n).selectExpr("'g' AS g", f"{shape} AS x")
            result = exact_quantiles(df, "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["g"], few_groups=few_groups)
            result.collect()
            ranked[n, shape] = max(window_inputs(result))
    assert max(ranked.values()) <= 6 * quantiles.CELLS, ranked


def window_inputs(df):
    """Rows that entered each window of the executed plan."""
    nodes = [(df._jdf.queryExecution().executedPlan(), False)]
    rows = []
    while nodes:
        node, below = nodes.pop()
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            nodes.append((node.executedPlan(), below))
            continue
        if "QueryStage" in name:
            nodes.append((node.plan(), below))
        if below and "HashAggregate" in name:
            rows.append(node.metrics().apply("numOutputRows").value())
            below = False
        children = node.children()
        nodes.extend((children.apply(i), below or name == "Window") for i in range(children.size()))
    return rows
