from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from marketspark.functions.lineage import shared
from marketspark.functions.periods import Period
from marketspark.operators import anomalies, charts, metrics, opportunities, reports
from marketspark.plans import bundles
from marketspark.sources import driver_tables as tables, readers, sinks
from tests.test_market import BOUNDS, frame, sale


def lines(folder):
    return [line for p in sorted(Path(folder).glob("part-*")) for line in p.read_text().splitlines()]


def test_transactions_csv(spark, tmp_path):
    header = ",".join(f.name for f in readers.TRANSACTIONS)
    good = "t1,1,1,Sales,2024-02-03,Unit,Flat,Off-Plan,Marina,Tower,Dev,null,Mall,null,2 B/R,1,90.5,900000,9944.7,null"
    (tmp_path / "good.csv").write_text(f"{header}\n{good}\n")
    row = readers.read_transactions_csv(spark, str(tmp_path / "good.csv")).first()
    assert (row["transaction_id"], row["actual_worth"], row["nearest_metro_en"], row["rent_value"]) == ("t1", 900000.0, None, None)
    (tmp_path / "bad.csv").write_text(f"{header}\n{good}\n{good.replace('900000', 'many')}\n")
    with pytest.raises(Exception, match="Malformed"):
        readers.read_transactions_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_supply_csv_is_latin1(spark, tmp_path):
    values = {c: "" for c in readers.SUPPLY_COLUMNS} | {"ID": "7", "Project_Name": "Café", "Total_Units": "12.0", "Launch_Date": "1/2/2024"}
    (tmp_path / "s.csv").write_bytes((",".join(values) + "\n" + ",".join(values.values()) + "\n").encode("latin-1"))
    row = readers.read_supply_csv(spark, str(tmp_path / "s.csv")).first()
    assert (row["project_id"], row["project_name"], row["total_units"], row["total_villas"], row["launch_date"]) == ("7", "Café", 12, None, "1/2/2024")


def test_warehouse_read_pushes_filter_and_columns(spark, tmp_path):
    rows = [(i, f"2024-0{1 + i % 9}-01", 2023 + i % 2, "x") for i in range(20)]
    spark.createDataFrame(rows, "id int, evidence_date string, Year int, unused string").write.parquet(str(tmp_path / "w"))
    df = readers.read_warehouse(spark, str(tmp_path / "w"), ["id", "evidence_date"], year=2024)
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Year,2024)" in plan and "unused" not in plan
    newest = readers.read_warehouse(spark, str(tmp_path / "w"), ["id", "evidence_date"], limit=2)
    assert [r["id"] for r in newest.collect()] == [8, 17]


def test_search_rows_filters(spark, tmp_path):
    import datetime

    rows = [(datetime.date(2024, 1, 1), p, "q", 1, 2, 0.5, 3.0) for p in ("/map", "/map/a", "/home")]
    spark.createDataFrame(rows, readers.SEARCH_ROWS).write.json(str(tmp_path / "r"))
    assert readers.read_search_rows(spark, str(tmp_path / "r"), "json", page_contains="map").count() == 2
    assert readers.read_search_rows(spark, str(tmp_path / "r"), "json", page="/map").count() == 1


def test_versions_are_appended_and_read_alone(spark, tmp_path):
    df = frame(spark, [sale(i, d) for i, d in enumerate(BOUNDS)])
    for version in (1, 2):
        sinks.append_version(df.limit(2 * version), str(tmp_path / "v"), version)
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert stored.groupBy("version_id").count().orderBy("version_id").collect() == [(1, 2), (2, 4)]
    plan = stored.where("version_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version_id" in plan


def test_typed_load_counts_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    for n in (5, 3):
        out = sinks.truncate_load(spark.range(n).select(F.col("id").alias("a"), F.lit("x").alias("b")), schema, str(tmp_path / "t"))
        assert tuple(out.first()) == (n, n)


def test_study_exports(spark, tmp_path):
    import datetime

    rows = [sale(i, datetime.date(2023 + i % 2, 1, 1), "old") for i in range(8)] + [sale(50, datetime.date(2024, 1, 1), "new")]
    years = (2023, 2024)
    study = opportunities.with_misleading_flags(opportunities.growth_study(frame(spark, rows), "area_name_en", years), years)
    sinks.export_study_json(study, str(tmp_path / "j"))
    assert sum('"growth_2_pct":"INFINITE"' in line for line in lines(tmp_path / "j")) == 1
    sinks.export_slices(opportunities.study_slices(study), str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir()} == {"all", "top_legitimate", "misleading", "high_volume", "declining"}
    assert any(line.startswith("name,") for line in lines(tmp_path / "s" / "all"))


def test_profile_and_catalog(spark):
    df = frame(spark, [sale(i, d, area=f"A{i % 2}") for i, d in enumerate(BOUNDS)])
    facts = {(r["section"], r["key"]): r["value"] for r in readers.source_profile(df, "instance_date", "property_type", "area_name_en").collect()}
    assert facts[("overall", "rows")] == "8" and facts[("overall", "first_date")] == "2023-12-31" and facts[("area", "A1")] == "4"
    assert ("actual_worth", "double") in {tuple(r) for r in readers.column_catalog(df).collect()}


def test_rebuild_writes_every_metric_table(spark, tmp_path):
    sales = frame(spark, [sale(i, BOUNDS[i % 8], area=f"A{i % 2}", luxury=i % 2 == 0, kind=("Off-Plan", "Existing")[i % 2]) for i in range(160)])
    names = bundles.rebuild_all(sales, str(tmp_path))
    assert len(names) == 18 and {p.name for p in tmp_path.iterdir()} == set(names)
    assert spark.read.parquet(str(tmp_path / "metrics_luxury_project_lists")).where("part <> 0").count() == 0
    stored = spark.read.parquet(str(tmp_path / "metrics_area"))
    assert sorted(stored.collect()) == sorted(metrics.area_metrics(sales).collect())
    ids = spark.read.parquet(str(tmp_path / "metrics_monthly_trend_ids"))
    assert ids.count() == spark.read.parquet(str(tmp_path / "metrics_monthly_trends")).agg(F.sum("tx_count")).first()[0]


def test_shared_results_go_to_the_checkpoint_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = shared(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert list(Path(folder).rglob("part-*"))


def test_periods_read_only_the_folders_of_their_years(spark, tmp_path):
    sales = tables.transactions(spark, "/root/testdata/sf0.001", "area", "type", "developer", "project", "rooms")
    sinks.append_version(sales, str(tmp_path / "sales"), 1)
    stored = spark.read.parquet(str(tmp_path / "sales")).where("version_id = 1")
    q2 = Period(1997, "quarterly", 2)
    # Summaries made their first scan, of the first frame here, when they were built; some have no second one.
    lazy = [stored.where(q2.contains()), anomalies.volume_spikes(stored, q2), charts.monthly_trend(stored, 1997)]
    for df in (*lazy, reports.period_metrics(stored, q2), reports.top_performers(stored, q2)):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and ("instance_date" in x or any(df is d for d in lazy))]
        assert scans or not any(df is d for d in lazy)
        assert all("transaction_year" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)
    assert reports.period_metrics(stored, q2).first() == reports.period_metrics(sales, q2).first()


def test_appending_a_version_twice_keeps_one(spark, tmp_path):
    sales = tables.transactions(spark, "/root/testdata/sf0.001").limit(50)
    for version in (1, 2, 1):
        sinks.append_version(sales, str(tmp_path / "again"), version)
    stored = spark.read.parquet(str(tmp_path / "again"))
    assert {r["version_id"]: r["count"] for r in stored.groupBy("version_id").count().collect()} == {1: 50, 2: 50}
