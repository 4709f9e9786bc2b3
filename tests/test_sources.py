import logging
import math
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

import samples
from quaestor.schemas import RAW_TABLES, raw_schema
from quaestor.sources import tables
from quaestor.sources.csv_tables import load_csv_tables, read_csv_table
from quaestor.verification.stores import Store

STOPPED = (PySparkException, Py4JJavaError)


@pytest.fixture
def database(spark):
    name = "loading"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_csv_keeps_types_values_and_nulls(spark, tmp_path):
    samples.write_csv(tmp_path)
    for table, rows in samples.ROWS.items():
        df = read_csv_table(spark, table, f"{tmp_path}/{table}.csv")
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in raw_schema(table)
        ]
        expected = samples.raw_frame(spark, table, rows)
        assert sorted(map(str, df.collect())) == sorted(map(str, expected.collect()))


def test_load_replaces_or_keeps_and_skips_missing_files(spark, tmp_path, database, caplog):
    samples.write_csv(tmp_path, ["clienti", "sinistri"])
    with caplog.at_level(logging.WARNING):
        assert load_csv_tables(spark, str(tmp_path), database) == ["clienti", "sinistri"]
    assert "polizze" in caplog.text
    counts = {r.table_name: r.row_count
              for r in tables.row_counts(tables.read_raw_tables(spark, database)).collect()}
    assert counts == {"clienti": len(samples.CUSTOMERS), "sinistri": len(samples.CLAIMS)}

    path = tmp_path / "sinistri.csv"
    path.write_text("\n".join(path.read_text(encoding="utf-8").splitlines()[:2]), encoding="utf-8")
    load_csv_tables(spark, str(tmp_path), database, replace=False, tables=["sinistri"])
    assert spark.table(f"{database}.sinistri").count() == len(samples.CLAIMS)
    load_csv_tables(spark, str(tmp_path), database, replace=True, tables=["sinistri"])
    assert spark.table(f"{database}.sinistri").count() == 1


def test_deliveries_are_compressed_and_load_whole(spark):
    store = Store(spark)
    rows = samples.raw_frame(spark, "abitazioni", samples.HOMES)
    folder = store.delivered({"abitazioni": rows}, "whole")
    files = [f.name for f in Path(folder.removeprefix("file:"), "abitazioni.csv").glob("part-*")]
    assert files and all(name.endswith(".csv.snappy") for name in files)
    assert load_csv_tables(spark, folder, store.database, tables=["abitazioni"]) == ["abitazioni"]
    got = spark.table(f"{store.database}.abitazioni").collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.collect()))
    for name in (store.database, f"{store.database}_marts"):
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_wrong_header_stops_the_load(spark, tmp_path):
    (tmp_path / "reclami.csv").write_text("Prodotto,codice_cliente,Area di Bisogno,Reclami_e_info\na,1,b,c\n")
    with pytest.raises(STOPPED, match="CSV header does not conform"):
        read_csv_table(spark, "reclami", f"{tmp_path}/reclami.csv").collect()


def test_bad_value_stops_the_load(spark, tmp_path):
    (tmp_path / "reclami.csv").write_text("codice_cliente,Prodotto,Area di Bisogno,Reclami_e_info\nx,a,b,c\n")
    with pytest.raises(STOPPED, match="MALFORMED_RECORD_IN_PARSING"):
        read_csv_table(spark, "reclami", f"{tmp_path}/reclami.csv").collect()


def test_catalog_listings(spark, tmp_path, database):
    samples.write_csv(tmp_path, ["abitazioni"])
    load_csv_tables(spark, str(tmp_path), database, tables=["abitazioni"])
    assert database in [r.database for r in tables.list_databases(spark).collect()]
    listed = tables.list_tables(spark, database).collect()
    assert (database, "abitazioni", "MANAGED") in [tuple(r) for r in listed]
    described = tables.describe_table(spark.table(f"{database}.abitazioni")).collect()
    assert [tuple(r) for r in described] == [
        (c.header, c.type.simpleString(), True) for c in RAW_TABLES["abitazioni"]
    ]


def test_views_are_there_for_sql(spark):
    tables.register_views({"some_homes": samples.raw_frame(spark, "abitazioni", samples.HOMES)})
    assert spark.sql("SELECT sum(Metratura) FROM some_homes").first()[0] == 150


def test_sample_has_exactly_n_rows_of_the_table(spark):
    df = spark.range(1000)
    got = [r.id for r in tables.sample_rows(df, 100, seed=3).collect()]
    assert len(got) == len(set(got)) == 100 and set(got) <= set(range(1000))
    assert math.isclose(sum(got) / 100, 499.5, rel_tol=0.3)
    assert tables.sample_rows(df, 5000).count() == 1000
    assert tables.head_rows(df, 7).count() == 7


def test_load_time_is_one_value_per_write(spark):
    df = tables.with_load_time(spark.range(10))
    assert df.select(tables.LOAD_TIME_COLUMN).distinct().count() == 1
