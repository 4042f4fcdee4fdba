from datetime import date

from pyspark.sql import functions as F

from marketspark.operators import supply, supply_ingest
from marketspark.sources import driver_tables as tables
from marketspark.sources.readers import SUPPLY_COLUMNS, SUPPLY_COUNTS

NAMES = list(SUPPLY_COLUMNS.values())
COUNTS = {SUPPLY_COLUMNS[c] for c in SUPPLY_COUNTS}
SCHEMA = ", ".join(f"{n} {'int' if n in COUNTS else 'string'}" for n in NAMES)
BASE = dict.fromkeys(NAMES) | dict(
    project_id="p", project_name="Tower", master_development="Marina", sub_location_1="North", developer="Damac Properties",
    developer_property_type=" Residential Tower ", status="HANDED OVER", launch_date="3/5/2020", actual_completion_date="2022-08-01",
    total_units=100, total_apartments=100, location_address="Street 1", height_class="High-rise", completion_percentage=100,
)


def enriched(spark, *changes):
    rows = [tuple({**BASE, "project_id": f"p{i}", **c}[n] for n in NAMES) for i, c in enumerate(changes)]
    out = supply_ingest.enrich(spark.createDataFrame(rows, SCHEMA))
    return {r["project_name"] if r["project_id"] is None else r["project_id"]: r for r in out.collect()}


def test_names_are_normalised(spark):
    got = enriched(
        spark, {}, {"developer_property_type": "Castle", "status": "Paused ", "developer": "None", "height_class": "MI"},
        {"developer_property_type": None, "status": None, "developer": " ", "height_class": "Super Tall"},
        {"status": "under CANCELLATION", "developer": "New Dev", "height_class": "Bungalow"},
    )
    columns = ("developer_property_type_normalized", "status_normalized", "developer", "height_class")
    assert [tuple(got[f"p{i}"][c] for c in columns) for i in range(4)] == [
        ("Apartment", "Completed", "DAMAC Properties", "High-Rise"),
        ("Other", "Paused", None, None),
        (None, None, None, "Supertall"),
        ("Apartment", "Cancelled", "New Dev", "Bungalow"),
    ]


def test_dates_quarters_and_paths(spark):
    got = enriched(
        spark, {}, {"actual_completion_date": None, "completion_month": 11, "completion_year": 2027, "launch_date": None},
        {"actual_completion_date": "12/31/2025", "launch_date": "bad", "sub_location_1": None}, {"actual_completion_date": None, "completion_year": 2027},
    )
    assert (got["p0"]["launch_date"], got["p0"]["delivery_quarter"], got["p0"]["delivery_index"]) == (date(2020, 3, 5), "Q3 2022", 2022 * 4 + 2)
    assert (got["p1"]["delivery_quarter"], got["p1"]["launch_date"], got["p1"]["launch_date_is_estimated"]) == ("Q4 2027", None, False)
    assert (got["p2"]["delivery_quarter"], got["p2"]["launch_date"], got["p2"]["launch_date_is_estimated"]) == ("Q4 2025", date(2023, 12, 31), True)
    assert got["p2"]["has_missing_launch_date"] and got["p2"]["location_full"] == "Marina" and got["p0"]["location_full"] == "Marina > North"
    assert got["p3"]["delivery_quarter"] is None and got["p3"]["delivery_index"] is None


def test_quality_scores(spark):
    got = enriched(
        spark, {}, {"master_development": None}, {"total_units": 0, "total_apartments": 0}, {"total_units": 150}, {"total_units": 9, "total_apartments": 4},
        {"developer": None, "location_address": ""}, {"launch_date": None, "actual_completion_date": None}, {"status": None}, {"project_name": None},
    )
    shown = [(round(got[f"p{i}"]["quality_score"], 6), got[f"p{i}"]["is_valid"]) for i in range(9)]
    assert shown == [(1.0, True), (0.6, False), (1.0, False), (0.8, True), (1.0, False), (0.765, True), (0.9, True), (0.9, True), (0.0, False)]
    assert got["p3"]["unit_mismatch_diff"] == 50 and got["p0"]["residential_units"] == 100


def test_classes_and_strict_offplan(spark):
    changes = [
        {"total_units": 0, "total_apartments": 0}, {"total_units": 49}, {"total_units": 50, "total_villas": 3, "total_townhouses": 1}, {"total_units": 200, "total_apartments": 0, "total_villas": 2},
        {"total_units": 500, "total_apartments": 0, "total_offices": 1},
    ]
    rows = [tuple({**BASE, "project_id": f"p{i}", **c}[n] for n in NAMES) for i, c in enumerate(changes)]
    df = supply_ingest.enrich(spark.createDataFrame(rows, SCHEMA)).orderBy("project_id")
    got = df.select(supply_ingest.size_class(), supply_ingest.unit_mix_class()).collect()
    assert [tuple(r) for r in got] == [
        ("Unknown", "Other"), ("Small", "Apartments Only"), ("Medium", "Includes Townhouses"), ("Large", "Villas Only"), ("Mega", "Commercial/Mixed")
    ]
    ahead = [{"status": "Launched", "completion_percentage": 10, "actual_completion_date": d} for d in ("2030-01-01", None, "2024-01-01")]
    ahead += [{"status": "Completed", "completion_percentage": 10, "actual_completion_date": None}, {"status": "Launched", "completion_percentage": 100, "actual_completion_date": None}]
    rows = [tuple({**BASE, "project_id": f"p{i}", **c}[n] for n in NAMES) for i, c in enumerate(ahead)]
    df = supply_ingest.enrich(spark.createDataFrame(rows, SCHEMA)).orderBy("project_id")
    assert [r[0] for r in df.select(supply_ingest.strictly_offplan(date(2026, 1, 8))).collect()] == [True, True, False, False, False]


def test_balance_labels(spark):
    ratios = [None, 0.0, 0.5, 1.0, 1.81, 2.8, 5.0, 42.9]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "i int, r double").orderBy("i")
    labels = [r[0] for r in df.select(supply.market_balance(F.col("r"))).collect()]
    assert labels == [
        "Insufficient Data", "Severely Undersupplied", "Undersupplied", "Balanced", "Slightly Oversupplied", "Slightly Oversupplied", "Oversupplied", "Severely Oversupplied"
    ]
    assert supply.parse_quarter("Q3 2026") == 2026 * 4 + 2


def test_missing_unit_counts_are_audited_before_the_fill(spark):
    raw = tables.supply_raw(spark, "/root/testdata/sf0.001").withColumn("total_units", F.lit(None).cast("int"))
    audit = {r["rule"]: r["failures"] for r in supply_ingest.rule_audit(supply_ingest.enrich(raw), date(2001, 6, 30)).collect()}
    assert audit["total units missing"] == raw.count()
