"""Distinct counts from bitmaps, tables replaced at once, and refreshed tables against full rebuilds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketspark.functions.lineage import shared
from marketspark.operators import distinct_cells, lookups
from marketspark.plans import refresh
from marketspark.sources import driver_tables as tables
from marketspark.sources.readers import latest_snapshot, open_bucketed, read_table
from marketspark.sources.sinks import bucketed_table, commit_table

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted([tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(df.columns)) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def named(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        day = datetime.date(rng.choice((1999, 2000)), rng.randint(1, 12), 1)
        area = rng.choice(["hot", "hot", "hot", "a", None])
        rows.append((area, day.year, day.month, rng.choice([None, f"p{rng.randint(0, 200)}"]), f"d{rng.randint(0, 20)}"))
    return spark.createDataFrame(rows, "area_name_en string, transaction_year int, transaction_month int, project_name_en string, developer string")


@pytest.mark.parametrize("keys", [[], ["area_name_en"]])
@pytest.mark.parametrize("kind, months", [(None, 0), ("monthly", 1), ("quarterly", 3), ("semi_annual", 6), ("annual", 12)])
def test_unions_of_cells_count_distinct_names(named, keys, kind, months):
    cells = distinct_cells.month_cells(named, distinct_cells.dictionary(named))
    got = distinct_cells.distinct_counts(cells, keys, kind)
    want, by = named, list(keys)
    if kind:
        by.append("period_index")
        n = 12 // months
        want = named.withColumn("period_index", (F.col("transaction_year") * n + F.floor((F.col("transaction_month") - 1) / months)).cast("int"))
    assert plain(got) == plain(want.groupBy(*by).agg(*[F.countDistinct(c).alias(a) for a, c in distinct_cells.COUNTED.items()]))


def test_counts_read_cells_only_and_appends_keep_ids(spark, named):
    early, late = named.where("transaction_year = 1999"), named.where("transaction_year = 2000")
    first = distinct_cells.dictionary(early)
    more = distinct_cells.dictionary(late, known=first)
    ids = {(r.attribute, r.name): r.id for r in more.collect()}
    assert {(r.attribute, r.name): r.id for r in first.collect()}.items() <= ids.items()
    for attribute in distinct_cells.COUNTED:
        mine = sorted(i for (a, _), i in ids.items() if a == attribute)
        assert mine == list(range(len(mine)))
    cells = distinct_cells.merged(distinct_cells.month_cells(early, first), distinct_cells.month_cells(late, more))
    whole = distinct_cells.month_cells(named, distinct_cells.dictionary(named))
    assert plain(distinct_cells.distinct_counts(cells, ["area_name_en"], "annual")) == plain(distinct_cells.distinct_counts(whole, ["area_name_en"], "annual"))
    plan = distinct_cells.distinct_counts(shared(cells), kind="quarterly")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("FileScan") == 1


def test_ids_beyond_one_bitmap(spark):
    many = spark.range(70_000).select(F.lit("a").alias("area_name_en"), F.lit(2000).alias("transaction_year"), (F.col("id") % 12 + 1).cast("int").alias("transaction_month"), F.col("id").cast("string").alias("project_name_en"), F.lit("d").alias("developer"))
    cells = distinct_cells.month_cells(many, distinct_cells.dictionary(many))
    assert distinct_cells.distinct_counts(cells).collect()[0].asDict() == {"unique_areas": 1, "unique_projects": 70_000, "unique_developers": 1}
    assert distinct_cells.distinct_counts(cells.limit(0)).collect()[0].asDict() == {"unique_areas": 0, "unique_projects": 0, "unique_developers": 0}


def test_a_failed_rewrite_leaves_the_table_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    commit_table(spark.range(3), path)
    before = latest_snapshot(spark, path)
    with pytest.raises(Exception, match="stop"):
        commit_table(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id")), path)
    assert latest_snapshot(spark, path) == before and read_table(spark, path).count() == 3
    # A table may be rewritten from itself, and a reader keeps what it opened.
    held = read_table(spark, path)
    commit_table(held.unionByName(spark.range(10, 12)), path)
    assert read_table(spark, path).count() == 5 and held.count() == 3 and latest_snapshot(spark, path)[0] == 2


def test_refreshed_tables_equal_a_full_rebuild(spark, tmp_path):
    sales = shared(tables.transactions(spark, SF).where("transaction_year >= 1999"))
    late = (F.col("instance_date") >= F.lit("2000-11-01").cast("date")) & (F.col("area_name_en") < "NATION_15")
    refresh.start(sales.where(~late), str(tmp_path / "kept"))
    untouched = tmp_path / "kept" / "metrics_offplan" / "transaction_year=1999"
    before = sorted((p.name, p.stat().st_mtime_ns) for p in untouched.rglob("part-*"))
    refresh.refresh(sales, sales.where(late), str(tmp_path / "kept"))
    assert before and before == sorted((p.name, p.stat().st_mtime_ns) for p in untouched.rglob("part-*"))
    refresh.start(sales, str(tmp_path / "anew"))
    for name in refresh.TABLES:
        kept, anew = (refresh.stored(spark, str(tmp_path / f), name) for f in ("kept", "anew"))
        assert plain(kept) == plain(anew.select(*kept.columns)), name


def test_bucketed_tables_prune_and_join_without_an_exchange(spark, tmp_path):
    areas = spark.range(200).select(F.concat(F.lit("a"), "id").alias("area_name_en"), F.col("id").alias("total_transactions"))
    shares = areas.select("area_name_en", *[F.col("total_transactions").cast("double").alias(c) for c in ("ready_count", "avg_offplan_price", "avg_ready_price", "offplan_percentage")])
    left = bucketed_table(areas, "buckets_left", str(tmp_path / "left"), ["area_name_en"], 8)
    bucketed_table(shares, "buckets_right", str(tmp_path / "right"), ["area_name_en"], 8)
    assert len(list((tmp_path / "left").glob("part-*"))) == 8
    right = open_bucketed(spark, "buckets_right_again", str(tmp_path / "right"), ["area_name_en"], 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        every = lookups.area_overview(left, right)
        plan = every._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 8 out of 8") == 2
        assert sorted(map(tuple, every.collect())) == sorted((f"a{i}", i, *[float(i)] * 4) for i in range(200))
        one = lookups.area_overview(left, right, "a7")
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 1 out of 8") == 2
        assert [tuple(r) for r in one.collect()] == [("a7", 7, 7.0, 7.0, 7.0, 7.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("buckets_left", "buckets_right", "buckets_right_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
