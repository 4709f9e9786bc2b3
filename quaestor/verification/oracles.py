"""DuckDB SQL that gives the expected result of every deterministic query."""

from __future__ import annotations

from pyspark.sql import types as T

from quaestor.operators import extracts
from quaestor.operators.checks import (
    EXPRESSION, NOT_NULL, RANGE, RELATIONSHIP, ROW_KINDS, UNIQUE, VALUES, Check,
)
from quaestor.plans.check_definitions import CHECKS
from quaestor.schemas import RAW_TABLES, staging_columns
from quaestor.verification.views import AS_OF, EARLY, renamed, with_views


def _rounded(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) * 1e{digits}) / 1e{digits}"


def _histogram(source: str, value: str, bins: int, log: bool = False) -> str:
    v = f"log10({value})" if log else f"CAST({value} AS DOUBLE)"
    where = f"{value} > 0" if log else f"{value} IS NOT NULL"
    start, stop = "start", "stop"
    if log:
        start, stop = _rounded("start"), _rounded("stop")
    return f"""
        SELECT CAST(i AS BIGINT) AS bin, {start} AS bin_start, {stop} AS bin_end,
            (SELECT count(*) FROM (SELECT {v} AS v FROM {source} WHERE {where})
             WHERE v >= start AND (v < stop OR (i = {bins - 1} AND v <= stop))) AS n
        FROM (
            SELECT i, low + i * ((high - low) / {bins}) AS start,
                CASE WHEN i = {bins - 1} THEN high
                    ELSE low + (i + 1) * ((high - low) / {bins}) END AS stop
            FROM (SELECT min({v}) AS low, max({v}) AS high FROM {source} WHERE {where})
            CROSS JOIN range({bins}) AS r(i)
        )
    """


def _box(source: str, value: str, by: str) -> str:
    return f"""
        SELECT {by}, n, q1, median, q3,
            least(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), q1) AS whisker_low,
            greatest(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high,
            count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))
                AS outliers
        FROM (
            SELECT {by}, CAST({value} AS DOUBLE) AS v, count(*) OVER g AS n,
                quantile_cont(CAST({value} AS DOUBLE), 0.25) OVER g AS q1,
                quantile_cont(CAST({value} AS DOUBLE), 0.5) OVER g AS median,
                quantile_cont(CAST({value} AS DOUBLE), 0.75) OVER g AS q3
            FROM {source} WHERE {value} IS NOT NULL AND {by} IS NOT NULL
            WINDOW g AS (PARTITION BY {by})
        ) GROUP BY {by}, n, q1, median, q3
    """


def _rounded_box(source: str, value: str, by: str) -> str:
    numbers = ", ".join(
        f"{_rounded(c)} AS {c}" for c in ("q1", "median", "q3", "whisker_low", "whisker_high")
    )
    return f"SELECT {by}, n, {numbers}, outliers FROM ({_box(source, value, by)})"


def _density(source: str, value: str, by: str | None = None, points: int = 200, reach: float = 0) -> str:
    group, on = (f"{by},", f"USING ({by})") if by else ("", "ON true")
    known = f"{value} IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")
    by_clause = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {group} CAST(i AS BIGINT) AS point, {_rounded("x", 9)} AS x,
            {_rounded("sum(exp(-0.5 * ((x - v) / h) ** 2)) / (n * h * sqrt(2 * pi()))", 9)}
                AS density
        FROM (
            SELECT *, (low - {reach} * h)
                + i * ((high + {reach} * h) - (low - {reach} * h)) / {points - 1} AS x
            FROM (
                SELECT {group} count(*) AS n, min({value}) AS low, max({value}) AS high,
                    stddev_samp({value}) * count(*) ** (-0.2) AS h
                FROM {source} WHERE {known} {by_clause}
            ) CROSS JOIN range({points}) AS r(i)
        ) JOIN (SELECT {group} {value} AS v FROM {source} WHERE {known}) {on}
        GROUP BY {group} i, x, n, h
    """


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _staging(*kinds: type[T.DataType]) -> list[tuple[str, str]]:
    return [
        (f"stg_{table}", c.staging)
        for table in RAW_TABLES
        for c in staging_columns(table)
        if isinstance(c.type, kinds)
    ]


def _raw(*kinds: type[T.DataType]) -> list[tuple[str, str]]:
    return [
        (table, f'"{c.header}"')
        for table, columns in RAW_TABLES.items()
        for c in columns
        if isinstance(c.type, kinds)
    ]


def _bare(column: str) -> str:
    return column.strip('"')


def _profile_columns() -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{c.header}' AS column_name,
            '{c.type.simpleString()}' AS data_type, count("{c.header}") AS non_null_count,
            count(*) FILTER (WHERE "{c.header}" IS NULL) AS null_count,
            round(avg(CASE WHEN "{c.header}" IS NULL THEN 1.0 ELSE 0.0 END) * 1000) / 10 AS null_pct
        FROM {table}"""
        for table, columns in RAW_TABLES.items()
        for c in columns
    ])


def _profile_numeric(columns: list[tuple[str, str]]) -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{_bare(column)}' AS column_name,
            count({column}) AS count, {_rounded(f"avg({column})")} AS mean,
            {_rounded(f"stddev_samp({column})")} AS std,
            CAST(min({column}) AS DOUBLE) AS min,
            {_rounded(f"quantile_cont(CAST({column} AS DOUBLE), 0.25)")} AS q25,
            {_rounded(f"quantile_cont(CAST({column} AS DOUBLE), 0.5)")} AS q50,
            {_rounded(f"quantile_cont(CAST({column} AS DOUBLE), 0.75)")} AS q75,
            CAST(max({column}) AS DOUBLE) AS max
        FROM {table}"""
        for table, column in columns
    ])


def _profile_histograms() -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{_bare(column)}' AS column_name, *
        FROM ({_histogram(table, column, 30)}) WHERE bin_start IS NOT NULL"""
        for table, column in _raw(T.LongType, T.DoubleType)
    ])


def _profile_top_values() -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{_bare(column)}' AS column_name,
            row_number() OVER (ORDER BY n DESC, value) AS position, value, n
        FROM (SELECT {column} AS value, count(*) AS n FROM {table}
              WHERE {column} IS NOT NULL GROUP BY value)
        QUALIFY position <= 20"""
        for table, column in _raw(T.StringType)
    ])


def _profile_categorical() -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{_bare(column)}' AS column_name,
            count(*) AS distinct_values, arg_min(value, (-n, value)) AS most_common,
            max(n) AS most_common_count,
            round(max(n) / (SELECT CAST(count(*) AS DOUBLE) FROM {table}) * 1000) / 10
                AS most_common_pct
        FROM (SELECT {column} AS value, count(*) AS n FROM {table}
              WHERE {column} IS NOT NULL GROUP BY value)"""
        for table, column in _raw(T.StringType)
    ])


def _profile_dates() -> str:
    return _union([
        f"""SELECT '{table}' AS table_name, '{_bare(column)}' AS column_name,
            min({column}) AS min_date, max({column}) AS max_date,
            CAST(max({column}) - min({column}) AS BIGINT) AS range_days
        FROM {table}"""
        for table, column in _raw(T.DateType)
    ])


def _duplicates(overview: bool, raw: bool = False) -> str:
    def one(table: str) -> str:
        name = table if raw else f"stg_{table}"
        columns = RAW_TABLES[table] if raw else staging_columns(table)
        extra = f"count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns," if overview else ""
        return f"""SELECT '{name}' AS table_name, {extra}
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}))
                AS duplicate_rows
        FROM {name}"""

    return _union([one(table) for table in RAW_TABLES])


def _describe_tables() -> str:
    names = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}
    words = " ".join(f"WHEN '{duck}' THEN '{spark}'" for duck, spark in names.items())
    return _union([
        f"""SELECT '{table}' AS table_name, '{c.header}' AS column_name,
            CASE any_value(typeof("{c.header}")) {words} END AS data_type
        FROM (SELECT count(*) AS n, any_value("{c.header}") AS "{c.header}" FROM {table})"""
        for table, columns in RAW_TABLES.items()
        for c in columns
    ])


def _failures(c: Check) -> str:
    column = f'"{c.column}"'
    if c.kind == UNIQUE:
        return f"""SELECT count(*) FROM (SELECT {column} FROM {c.table}
            WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"""
    if c.kind == RELATIONSHIP:
        return f"""SELECT count(*) FROM {c.table} WHERE {column} IS NOT NULL
            AND {column} NOT IN (SELECT "{c.parent_column}" FROM {c.parent}
                                 WHERE "{c.parent_column}" IS NOT NULL)"""
    if c.kind == VALUES:
        listed = ", ".join(f"'{v}'" for v in c.values)
        return f"SELECT count(DISTINCT {column}) FROM {c.table} WHERE {column} NOT IN ({listed})"
    condition = {
        NOT_NULL: f"{column} IS NULL",
        EXPRESSION: f"NOT ({column} {c.expression})",
        RANGE: " OR ".join(
            f"{column} {sign} {bound}"
            for sign, bound in (("<", c.low), (">", c.high))
            if bound is not None
        ),
    }[c.kind]
    return f"SELECT count(*) FROM {c.table} WHERE {condition}"


def _checks(*kinds: str, table: str | None = None) -> str:
    lines = _union([
        f"""SELECT '{c.kind}' AS check_kind, '{c.table}' AS table_name,
            '{c.column}' AS column_name, '{c.detail}' AS detail, '{c.severity}' AS severity,
            ({_failures(c)}) AS failures"""
        for c in CHECKS
        if c.kind in kinds and table in (None, c.table)
    ])
    return f"""SELECT *, CASE WHEN failures = 0 THEN 'pass'
        WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM ({lines})"""


def _share(source: str, column: str) -> str:
    return f"""SELECT {column}, n, CAST(n AS DOUBLE) / sum(n) OVER () * 100 AS pct
        FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL
              GROUP BY {column})"""


def _top(source: str, column: str, n: int) -> str:
    return f"""SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL
        GROUP BY {column} ORDER BY n DESC, {column} LIMIT {n}"""


def _premium_by(column: str) -> str:
    return f"""SELECT {column}, ifnull(sum(annual_premium), 0) AS total_premium
        FROM selected_policies WHERE {column} IS NOT NULL GROUP BY {column}"""


def _selects() -> dict[str, str]:
    sql = {
        "source_row_counts": _union([
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW_TABLES
        ]),
        "head_rows_check": """SELECT least(count(*), 100) AS rows, 0 AS strange, 0 AS doubled
            FROM stg_clienti""",
        "geo_sample_check": """SELECT least(count(*), 7000) AS rows, 0 AS strange, 0 AS doubled
            FROM geography""",
        "describe_tables": _describe_tables(),
        **{f"stg_{t}": f"SELECT * FROM stg_{t}" for t in RAW_TABLES},
        **{
            name: f"SELECT * FROM {name}"
            for name in (
                "int_customer_policies", "int_customer_claims", "int_customer_interactions",
                "dim_customers", "fact_policies",
            )
        },
        "mart_competitor_analysis": """
            SELECT *,
                rank() OVER (PARTITION BY tipo_prodotto ORDER BY premio_medio ASC NULLS LAST)
                    AS rank_premio,
                rank() OVER (PARTITION BY tipo_prodotto ORDER BY massimale_medio DESC NULLS LAST)
                    AS rank_copertura,
                rank() OVER (PARTITION BY tipo_prodotto ORDER BY rating_clienti DESC NULLS LAST)
                    AS rank_rating
            FROM market_rows""",
        # Extracts and filters
        "customer_demographics": "SELECT * FROM demographics",
        "policy_extract": "SELECT * FROM policies",
        "interaction_extract": renamed("stg_interazioni_clienti", extracts.INTERACTION),
        "customer_geography": "SELECT * FROM geography",
        "value_extract": renamed("stg_clienti", extracts.VALUE)
        + " WHERE engagement_score IS NOT NULL",
        "claims_extract": "SELECT * FROM dated_claims",
        "competitor_extract": renamed("stg_competitor_prodotti", extracts.COMPETITOR),
        "complaints_extract": renamed("stg_reclami", extracts.COMPLAINT),
        "housing_extract": renamed("stg_abitazioni", extracts.HOUSING),
        "filtered_customers": "SELECT * FROM selected",
        "filtered_policies": "SELECT * FROM selected_policies",
        "filter_ranges": """
            SELECT min(age) AS min_age, max(age) AS max_age, min(income) AS min_income,
                max(income) AS max_income FROM demographics""",
        "cluster_choices": "SELECT DISTINCT cluster FROM demographics WHERE cluster IS NOT NULL",
        "customer_value_metrics": """
            SELECT * FROM selected WHERE engagement_score IS NOT NULL
                AND churn_probability IS NOT NULL AND clv IS NOT NULL""",
        "lifecycle_stage_sql": "SELECT * FROM stages",
        "lifecycle_stage_binned": """
            SELECT *, CASE WHEN tenure_years > 10 THEN 'Loyal (10y+)'
                WHEN tenure_years > 5 THEN 'Mature (5-10y)'
                WHEN tenure_years > 2 THEN 'Growing (2-5y)'
                WHEN tenure_years > 0 THEN 'New (0-2y)' END AS lifecycle_stage
            FROM selected""",
        "engagement_by_tenure": """
            SELECT *, CASE WHEN tenure_years > 10 THEN 'Loyal (10y+)'
                WHEN tenure_years > 5 THEN 'Mature (5-10y)'
                WHEN tenure_years > 2 THEN 'Growing (2-5y)'
                WHEN tenure_years > 0 THEN 'New (0-2y)' END AS lifecycle_stage
            FROM selected WHERE engagement_score IS NOT NULL""",
        # Analyses
        "client_stats": """
            SELECT count(*) AS total_clients, count(DISTINCT codice_cliente) AS unique_clients
            FROM stg_clienti""",
        "policy_types": """
            SELECT prodotto, area_bisogno, count(*) AS count,
                round(avg(premio_totale_annuo) * 100) / 100 AS avg_annual_premium,
                round(avg(massimale) * 100) / 100 AS avg_insured_value
            FROM stg_polizze GROUP BY ALL""",
        "claims_by_product_status": """
            SELECT prodotto, area_bisogno, stato_liquidazione, count(*) AS count,
                round(avg(importo_liquidato) * 100) / 100 AS avg_paid
            FROM stg_sinistri GROUP BY ALL""",
        "complaint_types": """
            SELECT DISTINCT prodotto, area_bisogno, reclami_e_info FROM stg_reclami""",
        "complaints_by_product": """
            SELECT prodotto, area_bisogno, count(*) AS count,
                count(DISTINCT codice_cliente) AS unique_clients FROM stg_reclami GROUP BY ALL""",
        "interactions_by_type_outcome": """
            SELECT tipo_interazione, esito, count(*) AS count,
                round(avg(durata_minuti) * 10) / 10 AS avg_duration_minutes,
                count(*) FILTER (WHERE conversione) AS conversions
            FROM stg_interazioni_clienti GROUP BY ALL""",
        "properties_by_city": """
            SELECT luogo_residenza, count(*) AS count,
                round(avg(metratura) * 10) / 10 AS avg_square_meters,
                count(*) FILTER (WHERE sistema_allarme) AS with_alarm
            FROM stg_abitazioni GROUP BY ALL""",
        "competitor_products": """
            SELECT competitor, tipo_prodotto, round(avg(premio_medio) * 100) / 100 AS avg_premium,
                round(avg(massimale_medio) * 100) / 100 AS avg_coverage,
                round(avg(rating_clienti) * 100) / 100 AS avg_rating
            FROM stg_competitor_prodotti GROUP BY ALL""",
        "product_performance": "SELECT * FROM products",
        "top_products_by_premium": """
            SELECT * FROM products WHERE total_premium IS NOT NULL
            ORDER BY total_premium DESC, product, need_area LIMIT 10""",
        "channel_performance": "SELECT * FROM channels",
        "interaction_summary": "SELECT * FROM contacts",
        "cluster_summary": "SELECT * FROM clusters",
        "multi_claim_customers": """
            SELECT codice_cliente, nome, cognome, count(sinistro) AS total_claims,
                CAST(sum(importo_liquidato) AS DOUBLE) AS total_paid
            FROM stg_clienti JOIN stg_sinistri USING (codice_cliente) GROUP BY ALL
            HAVING count(sinistro) > 1 ORDER BY total_claims DESC, codice_cliente LIMIT 10""",
        "policy_trends": """
            SELECT data_emissione, prodotto, count(*) AS policies_started,
                CAST(sum(count(*)) OVER (PARTITION BY prodotto ORDER BY data_emissione) AS BIGINT)
                    AS cumulative_policies
            FROM stg_polizze GROUP BY data_emissione, prodotto""",
        "policy_trends_top": """
            SELECT data_emissione, prodotto, count(*) AS policies_started,
                CAST(sum(count(*)) OVER (PARTITION BY prodotto ORDER BY data_emissione) AS BIGINT)
                    AS cumulative_policies
            FROM stg_polizze GROUP BY data_emissione, prodotto
            ORDER BY prodotto, data_emissione LIMIT 20""",
        "customer_policy_join": """
            SELECT codice_cliente, nome, cognome, prodotto, area_bisogno, premio_totale_annuo,
                data_emissione, data_scadenza
            FROM stg_clienti JOIN stg_polizze USING (codice_cliente)""",
        "monthly_claims": """
            SELECT last_day(m) AS month_end,
                (SELECT count(*) FROM dated_claims WHERE date_trunc('month', claim_date) = m)
                    AS claims
            FROM (SELECT CAST(unnest(generate_series(
                date_trunc('month', min(claim_date)), date_trunc('month', max(claim_date)),
                INTERVAL 1 MONTH)) AS DATE) AS m FROM dated_claims)""",
        "premium_by_need_area": _premium_by("need_area"),
        "premium_by_product": _premium_by("product"),
        "premium_by_product_top": _premium_by("product")
        + " ORDER BY total_premium DESC, product LIMIT 3",
        "city_clv": """
            SELECT city, CAST(ifnull(sum(clv), 0) AS BIGINT) AS total_clv,
                count(clv) AS customer_count, avg(clv) AS avg_clv
            FROM selected_geography WHERE city IS NOT NULL GROUP BY city
            ORDER BY total_clv DESC, city LIMIT 15""",
        "market_share_by_competitor": """
            SELECT competitor, ifnull(sum(quota_mercato_perc), 0) AS market_share
            FROM stg_competitor_prodotti WHERE competitor IS NOT NULL GROUP BY competitor""",
        "cluster_share": _share("demographics", "cluster"),
        "claim_status_share": _share("dated_claims", "status"),
        "alarm_share": _share("stg_abitazioni", "sistema_allarme"),
        "top_professions": _top("selected", "profession", 10),
        "top_claim_products": _top("dated_claims", "product", 10),
        "top_complaint_products": _top("stg_reclami", "prodotto", 10),
        # Key figures
        "kpi_customers": f"""
            SELECT count(*) AS total_customers, avg(clv) AS avg_clv,
                avg(engagement_score) AS avg_engagement,
                {_rounded("avg(churn_probability)")} AS avg_churn_risk, avg(age) AS avg_age,
                avg(income) AS avg_income, avg(policy_count) AS avg_policies FROM selected""",
        "kpi_policies": """
            SELECT count(*) AS total_policies,
                count(*) FILTER (WHERE policy_status = 'Attiva') AS active_policies,
                ifnull(sum(annual_premium), 0) AS total_premium,
                avg(annual_premium) AS avg_premium FROM selected_policies""",
        "kpi_value": f"""
            SELECT avg(clv) AS avg_clv, avg(engagement_score) AS avg_engagement,
                {_rounded("avg(churn_probability)")} AS avg_churn_risk FROM selected
            WHERE engagement_score IS NOT NULL AND churn_probability IS NOT NULL
                AND clv IS NOT NULL""",
        "kpi_geography": """
            SELECT count(DISTINCT city) AS cities,
                CAST(ifnull(sum(clv), 0) AS BIGINT) AS total_clv, avg(clv) AS avg_clv
            FROM selected_geography""",
        "kpi_products": """
            SELECT count(DISTINCT product) AS products,
                ifnull(sum(total_premium), 0) AS total_revenue,
                CAST(ifnull(sum(total_margin), 0) AS BIGINT) AS total_margin FROM products""",
        "kpi_lifecycle": """
            SELECT avg(tenure_years) AS avg_tenure,
                count(*) FILTER (WHERE tenure_years < 2) AS new_customers,
                count(*) FILTER (WHERE tenure_years >= 10) AS loyal_customers,
                avg(annual_visits) AS avg_annual_visits FROM selected""",
        "kpi_channels": f"""
            SELECT count(*) AS channels, ifnull(sum(total_revenue), 0) AS total_revenue,
                (SELECT {_rounded("avg(conversion_rate)")} FROM contacts) AS avg_conversion_rate
            FROM channels""",
        "kpi_clusters": """
            SELECT count(*) AS clusters,
                (SELECT cluster FROM clusters ORDER BY customer_count DESC, cluster LIMIT 1)
                    AS largest_cluster,
                (SELECT cluster FROM clusters ORDER BY avg_clv DESC NULLS LAST, cluster LIMIT 1)
                    AS highest_clv_cluster
            FROM clusters""",
        # Profiles
        "profile_columns": _profile_columns(),
        "profile_nulls": f"""
            SELECT table_name, column_name, null_count FROM ({_profile_columns()})
            WHERE null_count > 0""",
        "profile_numeric": _profile_numeric(_staging(T.LongType, T.DoubleType)),
        "profile_numeric_raw": _profile_numeric(_raw(T.LongType, T.DoubleType)),
        "profile_histograms": _profile_histograms(),
        "profile_duplicates_raw": _duplicates(overview=False, raw=True),
        "profile_overview_raw": _duplicates(overview=True, raw=True),
        "profile_top_values": _profile_top_values(),
        "profile_categorical": _profile_categorical(),
        "profile_dates": _profile_dates(),
        "profile_duplicates": _duplicates(overview=False),
        "profile_overview": _duplicates(overview=True),
        # Distributions
        "hist_age": _histogram("demographics", "age", 30),
        "hist_income": _histogram("demographics", "income", 30),
        "hist_clv": _histogram("demographics", "clv", 50),
        "hist_tenure": _histogram("stages", "tenure_years", 20),
        "hist_property_size": _histogram("stg_abitazioni", "metratura", 30),
        "hist_claim_amount_log": _histogram("dated_claims", "claim_amount", 50, log=True),
        "box_premium_by_area": _rounded_box("policies", "annual_premium", "need_area"),
        "box_clv_by_cluster": _rounded_box(
            "(SELECT * FROM demographics WHERE engagement_score IS NOT NULL)", "clv", "cluster"
        ),
        "box_churn_by_stage": _rounded_box("stages", "churn_probability", "lifecycle_stage"),
        "density_age": _density("demographics", "age"),
        "density_income": _density("demographics", "income"),
        "density_tenure": _density("stages", "tenure_years"),
        "density_property_size": _density("stg_abitazioni", "metratura"),
        "density_visits_by_stage": _density(
            "stages", "annual_visits", "lifecycle_stage", points=100, reach=2
        ),
        # Data checks
        "dq_row_checks": _checks(*ROW_KINDS),
        "dq_unique": _checks(UNIQUE),
        "dq_relationships": _checks(RELATIONSHIP),
        "dq_accepted_values": _checks(VALUES),
        "dq_report": _checks(*ROW_KINDS, UNIQUE, RELATIONSHIP, VALUES),
    }
    sql |= {
        "csv_load_homes": "SELECT * FROM abitazioni",
        "csv_load_counts": sql["source_row_counts"],
        "catalogue_tables": _union([
            f"SELECT '{t}' AS table_name, 'MANAGED' AS table_type" for t in RAW_TABLES
        ]),
        "described_tables": f"SELECT *, true AS nullable FROM ({sql['describe_tables']})",
        "saved_fact_policies": sql["fact_policies"],
        "saved_check_report": sql["dq_report"],
        "view_claims": sql["int_customer_claims"],
        "report_cities": sql["city_clv"],
        "report_policies": sql["kpi_policies"],
    }
    return sql


def oracle_sql() -> dict[str, str]:
    expected = {name: with_views(select) for name, select in _selects().items()}
    early = with_views(_checks(*ROW_KINDS, table="int_customer_claims"))
    expected["dq_claims_early"] = early.replace(f"year(DATE '{AS_OF}')", f"year(DATE '{EARLY}')")
    return expected
