from datetime import date, datetime

from pyspark.sql import functions as F

from marketspark.config import PRICE_RULES, MarketConfig
from marketspark.operators import ingest

RAW = """id string, evidence_date date, master_development string, sub_loc_1 string, dev_name string, no_beds string, unit_bua_sqm double,
total_sales_price double, sales_price_sqm_unit double, unit_type string, sale_sequence string, off_plan int, Year int, Month int"""


def raw(spark, *changes):
    base = dict(
        id="t", evidence_date=date(2024, 3, 5), master_development="Marina", sub_loc_1="Tower", dev_name="Dev", no_beds="2", unit_bua_sqm=90.0,
        total_sales_price=900_000.0, sales_price_sqm_unit=10_000.0, unit_type="Apartment", sale_sequence="Offplan", off_plan=1, Year=2024, Month=3,
    )
    rows = [tuple({**base, "id": f"t{i}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, RAW)


def test_rows_are_mapped(spark):
    beds = ["s", "S", "studio", "3", "12", "7+", "loft", "", None]
    df = ingest.map_warehouse_rows(raw(spark, *[{"no_beds": b} for b in beds]))
    got = {r["transaction_id"]: r["rooms_en"] for r in df.collect()}
    want = ["Studio", "Studio", "Studio", "3 B/R", "12 B/R", "7+ B/R", "loft", "", ""]
    assert [got[f"t{i}"] for i in range(len(beds))] == want
    kinds = ingest.map_warehouse_rows(raw(spark, {"unit_type": "Whole Building", "sale_sequence": "ReSale"}, {"unit_type": "Shed", "sale_sequence": ""})).orderBy("transaction_id").collect()
    assert [(r["property_type_en"], r["transaction_type"]) for r in kinds] == [("Building", "Existing"), ("Unit", "Unknown")]


def test_rows_are_validated(spark):
    changes = [
        {}, {"id": ""}, {"master_development": None}, {"unit_type": "Hotel Apartment"}, {"unit_type": None}, {"total_sales_price": None},
        {"total_sales_price": 0.0}, {"total_sales_price": 49_999.0}, {"total_sales_price": 50_000.0},
        {"unit_type": "Villa", "total_sales_price": 99_999.0}, {"total_sales_price": 5_000_000.0},
    ]
    df = raw(spark, *changes)
    df = df.withColumn("id", F.when(F.col("id") == "", None).otherwise(F.col("id")))
    got = ingest.validate_warehouse_rows(ingest.map_warehouse_rows(df)).orderBy("actual_worth", "transaction_id")
    result = {r["transaction_id"]: (r["quality_score"], r["is_valid"], r["is_luxury"]) for r in got.collect()}
    no = (0.0, False, False)
    assert result["t0"] == (1.0, True, False)
    assert result[""] == no
    assert result["t2"] == (0.8, True, False)
    assert [result[f"t{i}"] for i in (3, 4, 5, 6, 7, 9)] == [no] * 6
    assert result["t8"] == (1.0, True, False)
    assert result["t10"] == (1.0, True, True)


def test_newest_copy_is_kept_and_deduplication_is_idempotent(spark):
    rows = [
        ("a", date(2024, 1, 1), 5.0, "x"), ("a", date(2024, 2, 1), 3.0, "y"), ("b", date(2024, 1, 1), 5.0, "x"), ("b", date(2024, 1, 1), 9.0, "z"),
        ("c", None, 1.0, "x"), ("c", date(2020, 1, 1), 0.5, "x"), ("d", date(2024, 1, 1), 2.0, "n"), ("d", date(2024, 1, 1), 2.0, "m"),
    ]
    df = spark.createDataFrame(rows, "transaction_id string, instance_date date, actual_worth double, note string")
    once = ingest.deduplicate(df)
    got = {r["transaction_id"]: (r["actual_worth"], r["note"]) for r in once.collect()}
    assert got == {"a": (3.0, "y"), "b": (9.0, "z"), "c": (0.5, "x"), "d": (2.0, "m")}
    assert sorted(ingest.deduplicate(once).collect()) == sorted(once.collect())


def test_price_verdicts(spark):
    prices = [None, 0.0, 49_999.0, 50_000.0, 199_999.0, 200_000.0, 50_000_001.0, 100_000_001.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "i int, p double")
    got = df.select("i", ingest.price_verdict(F.col("p"), F.lit("Unit"), PRICE_RULES).alias("v")).orderBy("i").collect()
    assert [(r["v"]["is_valid"], r["v"]["score"]) for r in got] == [
        (False, 0.0), (False, 0.0), (False, 0.0), (True, 0.6), (True, 0.6), (True, 1.0), (True, 0.6), (False, 0.0)
    ]
    other = df.where("i = 3").select(ingest.price_verdict(F.col("p"), F.lit("Tent"), PRICE_RULES).alias("v")).first()["v"]
    assert (other["is_valid"], other["score"]) == (True, 0.7)
    sqm = spark.createDataFrame([(i, p) for i, p in enumerate([None, 99.0, 100.0, 500.0, 80_001.0, 150_001.0])], "i int, p double")
    scores = [r[0]["score"] for r in sqm.orderBy("i").select(ingest.sqm_verdict(F.col("p"))).collect()]
    assert scores == [0.5, 0.0, 0.6, 1.0, 0.6, 0.0]


def test_composite_quality(spark):
    columns = "trans_group_en string, actual_worth double, property_type_en string, meter_sale_price double, instance_date string, transaction_id string, area_name_en string"
    rows = [
        ("Sales", 900_000.0, "Unit", 9_000.0, "05-03-2024", "t", "Marina"),
        ("Sales", 900_000.0, "Unit", None, "05-03-2024", "t", ""),
        ("Sales", 10.0, "Unit", 9_000.0, "05-03-2024", "t", "Marina"),
        ("Gifts", 10.0, "Unit", 9_000.0, "nothing", "t", "Marina"),
        ("Sales", 900_000.0, "Unit", 9_000.0, "05-03-1999", "t", "Marina"),
    ]
    config = MarketConfig()
    got = [r[0] for r in spark.createDataFrame(rows, columns).select(ingest.composite_quality(config.price_rules, config.years)).collect()]
    assert [round(x, 6) for x in got] == [1.0, round((1 + 1 + 0.3) / 3, 6), 0.0, round((1 + 0.5 + 1) / 3, 6), 0.0]


def test_dates_that_do_not_parse_have_no_year(spark):
    texts = ["2024-02-29", "2024-11-30 00:00:00", "29.02.2024", "soon", None, "2023-02-29"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, instance_date string")
    got = [(r["transaction_year"], r["transaction_month"]) for r in ingest.with_year_month(df).orderBy("i").collect()]
    assert got == [(2024, 2), (2024, 11), (None, None), (None, None), (None, None), (None, None)]


def test_versions(spark):
    columns = "version_id int, version_name string, import_date timestamp"
    versions = spark.createDataFrame(
        [(1, "Sales: a", datetime(2024, 1, 1)), (2, "Sales: b", datetime(2024, 2, 1)), (3, "Supply: c", datetime(2024, 3, 1))], columns
    )
    assert ingest.next_version_id(versions).first()[0] == 4
    assert ingest.next_version_id(versions.limit(0)).first()[0] == 1
    active = ingest.with_active_flag(versions)
    assert {r["version_id"]: r["is_active"] for r in active.collect()} == {1: False, 2: True, 3: True}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "version_id int, name string")
    assert [r["name"] for r in ingest.current_version(rows, active).collect()] == ["y"]


def test_views_are_nested(spark):
    columns = "transaction_id string, is_valid boolean, quality_score double, transaction_type string, originally_offplan boolean, is_luxury boolean"
    rows = [("a", True, 1.0, "Off-Plan", True, True), ("b", True, 0.6, "Existing", True, True), ("c", True, 0.7, None, True, False),
            ("d", False, 1.0, "Existing", False, True), ("e", True, 0.8, "Existing", True, False), ("f", True, 0.8, "Existing", False, False)]
    kept = ingest.clean(spark.createDataFrame(rows, columns))
    assert sorted(r["transaction_id"] for r in kept.collect()) == ["a", "e", "f"]
    named = {r["transaction_id"]: r["c"] for r in kept.withColumn("c", ingest.sale_classification()).collect()}
    assert named == {"a": "Off-Plan (Developer Sale)", "e": "Resale (Off-Plan Origin)", "f": "Resale"}
    assert [r["transaction_id"] for r in ingest.luxury(kept).collect()] == ["a"]
