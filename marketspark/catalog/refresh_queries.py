"""Registered queries: distinct counts from bitmaps, tables replaced at once, and tables refreshed after an append."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketspark.catalog.metric_queries import M3_CTE
from marketspark.catalog.registry import REGISTERED, TX, register
from marketspark.catalog.service_queries import SIZES
from marketspark.functions.lineage import shared, shared_folder
from marketspark.operators import distinct_cells, lookups, metrics
from marketspark.plans import refresh
from marketspark.sources import driver_tables as tables
from marketspark.sources.readers import read_table
from marketspark.sources.sinks import bucketed_table, commit_table

_NAMES = "count(DISTINCT project_name_en) AS unique_projects, count(DISTINCT developer) AS unique_developers"
_ALL = f"count(DISTINCT area_name_en) AS unique_areas, {_NAMES}"


def _cells(spark, sf):
    sales = tables.transactions(spark, sf, "area", "developer", "project")
    return shared(distinct_cells.month_cells(sales, distinct_cells.dictionary(sales)))


@register("p2_distinct_names_by_month", TX + f"SELECT CAST(year(instance_date) * 12 + month(instance_date) - 1 AS INTEGER) AS period_index, {_ALL} FROM tx GROUP BY 1")
def p2_distinct(spark, sf):
    return distinct_cells.distinct_counts(_cells(spark, sf), kind="monthly")


@register("p10_distinct_names_by_area_and_quarter", TX + f"""
SELECT area_name_en, CAST(year(instance_date) * 4 + quarter(instance_date) - 1 AS INTEGER) AS period_index, {_NAMES} FROM tx GROUP BY 1, 2""")
def p10_distinct(spark, sf):
    return distinct_cells.distinct_counts(_cells(spark, sf), ["area_name_en"], "quarterly", ("unique_projects", "unique_developers"))


@register("m15_distinct_names_of_the_market", TX + f"SELECT {_ALL} FROM tx")
def m15_distinct(spark, sf):
    return distinct_cells.distinct_counts(_cells(spark, sf))


@register("p9_distinct_names_after_an_append", TX + f"SELECT area_name_en, year(instance_date)::INTEGER AS period_index, {_NAMES} FROM tx GROUP BY 1, 2")
def p9_distinct(spark, sf):
    """Cells of the sales up to 1999, then those of the later ones merged into them."""
    sales = tables.transactions(spark, sf, "area", "developer", "project")
    early, late = (sales.where(w) for w in ("transaction_year <= 1999", "transaction_year > 1999"))
    names = distinct_cells.dictionary(early)
    first = distinct_cells.month_cells(early, names)
    names = distinct_cells.dictionary(late, known=names)
    cells = shared(distinct_cells.merged(first, distinct_cells.month_cells(late, names)))
    return distinct_cells.distinct_counts(cells, ["area_name_en"], "annual", ("unique_projects", "unique_developers"))


@register("s6_committed_table", TX + "SELECT developer, count(*) AS total_transactions, count(*) FILTER (is_luxury) AS luxury_units FROM tx GROUP BY 1 HAVING count(*) >= 10")
def s6_committed(spark, sf):
    """The developer table, written for the sales up to 1999, replaced by that of all sales, and read through the pointer."""
    path = f"{shared_folder(spark)}/developers-{uuid.uuid4().hex}"
    sales = shared(tables.transactions(spark, sf, "area", "developer", "project"))
    commit_table(metrics.developer_metrics(sales.where("transaction_year <= 1999")), path)
    commit_table(metrics.developer_metrics(sales), path)
    return read_table(spark, path).select("developer", "total_transactions", "luxury_units")


@register("l2_area_overview_of_bucketed_tables", f"""SELECT area_name_en, total_transactions, avg_price, ready_count, avg_offplan_price, avg_ready_price, offplan_percentage
FROM ({REGISTERED["m1_area_metrics"].sql}) LEFT JOIN (SELECT area_name_en, ready_count, avg_offplan_price, avg_ready_price, offplan_percentage FROM ({REGISTERED["m14_offplan_comparison"].sql})) USING (area_name_en)""")
def l2_bucketed(spark, sf):
    """Two metric tables stored in buckets of the area and joined bucket by bucket."""
    stored = []
    for query in ("m1_area_metrics", "m14_offplan_comparison"):
        name = f"{query}_{uuid.uuid4().hex}"
        stored.append(bucketed_table(REGISTERED[query].build(spark, sf), name, f"{shared_folder(spark)}/{name}", ["area_name_en"], 8))
    return lookups.area_overview(*stored).select("area_name_en", "total_transactions", "avg_price", "ready_count", "avg_offplan_price", "avg_ready_price", "offplan_percentage")


_SIZES = SIZES | {
    "metrics_monthly_trend_ids": "SELECT 1 FROM tx JOIN m3 USING (area_name_en, transaction_year, transaction_month, property_type)",
    "metrics_price_changes": "SELECT 1 FROM m3",
    "metrics_yoy_comparison": "SELECT DISTINCT area_name_en, transaction_year, property_type FROM m3",
    "metrics_luxury": "SELECT 1 FROM tx WHERE is_luxury GROUP BY area_name_en, transaction_year, transaction_month HAVING count(*) >= 3",
}


@register("m17_refreshed_table_sizes", M3_CTE + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM ({q})" for n, q in _SIZES.items()))
def m17_refreshed(spark, sf):
    """All metric tables, built from the sales before July 2000 and refreshed with the later ones."""
    folder = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    sales = shared(tables.transactions(spark, sf))
    early = F.col("instance_date") < F.lit("2000-07-01").cast("date")
    refresh.start(sales.where(early), folder)
    refresh.refresh(sales, sales.where(~early), folder)
    out = None
    for name in refresh.TABLES:
        part = refresh.stored(spark, folder, name).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
