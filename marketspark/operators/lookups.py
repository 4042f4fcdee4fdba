"""Lookups served over the metric tables and the sales: filters, orders and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marketspark.functions.expr import count_where, rows
from marketspark.functions.scale import Quantile, summarise
from marketspark.operators.metrics import PRICE, offplan

AREA_SORTS = (
    "total_transactions", "unique_projects", "avg_price", "median_price", "avg_price_sqm", "luxury_count", "offplan_count",
)
MAX_TRANSACTIONS = 1000


def _matching(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def areas(area_metrics: DataFrame, min_transactions: int = 10, sort_by: str = "total_transactions", limit: int = 50, luxury_only: bool = False) -> DataFrame:
    if sort_by not in AREA_SORTS:
        raise ValueError(f"areas cannot be sorted by {sort_by}")
    kept = area_metrics.where(F.col("total_transactions") >= min_transactions)
    if luxury_only:
        kept = kept.where(F.col("luxury_count") > 0)
    return kept.orderBy(F.desc(sort_by), "area_name_en").limit(limit)


def area_months(trends: DataFrame, area: str | None = None, months: int = 24) -> DataFrame:
    """The newest rows of the monthly trends of one area, or of every area."""
    order = Window.partitionBy("area_name_en").orderBy(F.desc("transaction_year"), F.desc("transaction_month"), "property_type")
    ranked = _matching(trends, area_name_en=area).withColumn("row", F.row_number().over(order))
    return ranked.where(F.col("row") <= months)


def area_projects(projects: DataFrame, area: str | None = None, limit: int = 10) -> DataFrame:
    order = Window.partitionBy("area_name_en").orderBy(F.desc("tx_count"), "project_name_en", "developer", "transaction_type")
    ranked = _matching(projects, area_name_en=area).withColumn("row", F.row_number().over(order))
    return ranked.where(F.col("row") <= limit)


def area_detail(
    area: str, area_metrics: DataFrame, trends: DataFrame, room_metrics: DataFrame, projects: DataFrame, comparison: DataFrame
) -> dict[str, DataFrame]:
    """Everything the metric tables know about one area."""
    here = F.col("area_name_en") == area
    return {
        "metrics": area_metrics.where(here),
        "monthly_trends": area_months(trends, area),
        "property_types": room_metrics.where(here).orderBy(F.desc("tx_count"), "property_type", "rooms_en"),
        "top_projects": area_projects(projects, area),
        "offplan_comparison": comparison.where(here),
    }


def area_overview(area_metrics: DataFrame, comparison: DataFrame, area: str | None = None) -> DataFrame:
    """Metrics next to the off-plan comparison, of one area or of every area. Tables bucketed by area need no exchange."""
    kept = _matching(area_metrics, area_name_en=area)
    shown = _matching(comparison, area_name_en=area).select("area_name_en", "ready_count", "avg_offplan_price", "avg_ready_price", "offplan_percentage")
    return kept.join(shown, "area_name_en", "left")


def price_changes(changes: DataFrame, area: str, property_type: str | None = None) -> DataFrame:
    kept = _matching(changes, area_name_en=area, property_type=property_type)
    return kept.orderBy("transaction_year", "transaction_month", "property_type")


def luxury_months(luxury: DataFrame, year: int | None = None, min_transactions: int = 3) -> DataFrame:
    kept = _matching(luxury, transaction_year=year).where(F.col("luxury_tx_count") >= min_transactions)
    return kept.orderBy(F.desc("transaction_year"), F.desc("transaction_month"), F.desc("luxury_tx_count"), "area_name_en")


def luxury_areas(summary: DataFrame, limit: int = 50) -> DataFrame:
    return summary.orderBy(F.desc("total_luxury_transactions"), "area_name_en").limit(limit)


def developers(developer_metrics: DataFrame, min_transactions: int = 10, limit: int = 50) -> DataFrame:
    kept = developer_metrics.where(F.col("total_transactions") >= min_transactions)
    return kept.orderBy(F.desc("total_transactions"), "developer").limit(limit)


def developer_detail(developer: str, developer_metrics: DataFrame, projects: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    own = F.col("developer") == developer
    order = (F.desc("tx_count"), "project_name_en", "area_name_en", "transaction_type")
    return {"metrics": developer_metrics.where(own), "projects": projects.where(own).orderBy(*order).limit(limit)}


def projects(
    project_metrics: DataFrame, area: str | None = None, developer: str | None = None, sale_type: str | None = None,
    min_transactions: int = 5, limit: int = 50,
) -> DataFrame:
    kept = _matching(project_metrics, area_name_en=area, developer=developer, transaction_type=sale_type)
    kept = kept.where(F.col("tx_count") >= min_transactions)
    return kept.orderBy(F.desc("tx_count"), "project_name_en", "developer", "area_name_en", "transaction_type").limit(limit)


def offplan_summary(sales: DataFrame) -> DataFrame:
    return summarise(
        sales.where(offplan()),
        [],
        [
            rows().alias("total_offplan"),
            F.avg(PRICE).alias("avg_price"),
        ],
        [Quantile("median_price", PRICE, 0.5)],
        distinct={"areas": "area_name_en", "projects": "project_name_en"},
    )


def offplan_areas(comparison: DataFrame, above: int = 100, limit: int = 15) -> DataFrame:
    return comparison.where(F.col("offplan_count") > above).orderBy(F.desc("offplan_count"), "area_name_en").limit(limit)


def transactions(
    sales: DataFrame, area: str | None = None, min_price: float | None = None, max_price: float | None = None,
    property_type: str | None = None, year: int | None = None, limit: int = 100,
) -> DataFrame:
    """Newest sales that meet all given conditions, at most 1000."""
    if not 0 < limit <= MAX_TRANSACTIONS:
        raise ValueError(f"limit must be between 1 and {MAX_TRANSACTIONS}")
    kept = _matching(sales, area_name_en=area, property_type=property_type, transaction_year=year)
    if min_price is not None:
        kept = kept.where(F.col(PRICE) >= min_price)
    if max_price is not None:
        kept = kept.where(F.col(PRICE) <= max_price)
    return kept.orderBy(F.desc("instance_date"), "transaction_id").limit(limit)


def yearly_volume(sales: DataFrame) -> DataFrame:
    return sales.groupBy("transaction_year").agg(rows().alias("transactions"), F.avg(PRICE).alias("avg_price"))


def monitoring_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        rows().alias("total_tx"),
        F.countDistinct("area_name_en").alias("total_areas"),
        count_where(F.col("is_luxury")).alias("luxury_tx"),
        F.max("transaction_year").alias("latest_year"),
    )


def room_comparison(room_metrics: DataFrame, rooms: Sequence[str]) -> DataFrame:
    """Chosen numbers of rooms side by side; averages over the metric rows, unweighted."""
    kept = room_metrics.where(F.col("rooms_en").isin(*rooms))
    return kept.groupBy("rooms_en").agg(
        F.countDistinct("area_name_en").alias("areas_available"),
        F.sum("tx_count").alias("total_transactions"),
        F.avg("avg_price").alias("avg_price"),
        F.avg("avg_price_sqm").alias("avg_price_sqm"),
        F.avg("avg_size_sqm").alias("avg_size_sqm"),
    )
