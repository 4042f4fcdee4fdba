"""Plans of all registered queries, and a few of them against their SQL."""

from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marketspark.catalog.registry import REGISTERED
from marketspark.sources import driver_tables as tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample data")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def test_every_query_is_registered_once_with_sql():
    assert {n for n, q in REGISTERED.items() if q.sql is None} == set()
    assert set(REGISTERED) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


# Every fourth query, and those that compare a result with a total, a range or a neighbour.
SHAPES = ("c3", "c6", "c8_offplan_report", "c9", "c12", "d6", "i1", "o2", "o4", "t1", "u", "v7", "w7", "x3", "x6", "g14")
PLANNED = [n for i, n in enumerate(sorted(REGISTERED)) if i % 4 == 0 or n.startswith(SHAPES)]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_engine_and_avoid_products(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_scans_read_only_what_a_query_needs(spark):
    plan = entry.queries()["s1_transactions_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    plan = entry.queries()["s2_warehouse_pull"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    plan = entry.queries()["e15_deduplicate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["m1_area_metrics", "p10_time_series", "o2_undervalued_areas", "c3_comparable_areas", "u1_supply_demand_areas", "g8_content_gaps"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted([tuple(str(v) for _, v in sorted(zip(columns, row))) for row in cursor.fetchall()])
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(str(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


# Queries of several summaries that read the sample tables once and go on from the stored sales.
@pytest.mark.parametrize("name", ["c13_developer_reports", "l5_developer_detail", "l2_area_detail", "x3_document_verdicts", "m10_project_metrics"])
def test_summaries_of_a_query_share_its_sales(spark, name):
    files = entry.queries()[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


@pytest.fixture(scope="module")
def many_names(spark, tmp_path_factory):
    """Tables with an area of 1,300 developers and 1,100 projects, all of them with a luxury sale in one month; some have no name."""
    folder = str(tmp_path_factory.mktemp("many_names"))
    lines = [(i, i % 1100, i % 1300, 1) for i in range(1400)] + [(i, i % 50, 1300 + i % 20, 2) for i in range(2000, 2040)]
    rows = {
        "nation": [(0, "NATION_0", 0), (1, "NATION_1", 0)],
        "supplier": [(k, f"Supplier {k}" if k % 400 else None, int(k >= 1300), 1.0) for k in range(1320)],
        "part": [(k, f"part {k}" if k % 300 else None, "Brand#1", "LARGE", 1 + k % 9, 900.0) for k in range(1100)],
        "lineitem": [
            (order, p, s, 1, 2.0, 95_000.0 + order, 0.0, 0.0, "NA"[order % 2], "O", datetime(2000, month, 1 + order % 28)) for order, p, s, month in [*lines, *lines[:9]]
        ],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, tables.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["l1_areas", "m1_area_metrics", "m7_luxury_monthly"])
def test_lists_of_any_number_of_names_match_their_sql(spark, many_names, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{many_names}/{t}.parquet/*.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(columns, row))) for row in cursor.fetchall())
    df = entry.queries()[name](spark, many_names)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(str(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
    assert max(v.count(", ") for row in want for v in row) > 1000
