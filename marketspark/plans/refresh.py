"""Metric tables kept up to date by what was added, instead of built anew.

A row of a metric table depends on the sales of its group only (an area, a project, an area in a month, ...). After an
append the groups that the added sales touch are computed again and replace their rows; all others stay as stored.

Tables by month are partitioned by year and month: only the folders of months that the added sales lie in are read from the
sales and written, by dynamic partition overwrite. Other tables are merged into a new snapshot, which readers see once it
is complete (sinks.commit_table).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketspark.functions.lineage import shared
from marketspark.functions.scale import join_on, name_rows
from marketspark.operators import metrics
from marketspark.sources.readers import read_table
from marketspark.sources.sinks import commit_table

MONTH = ("transaction_year", "transaction_month")


@dataclass(frozen=True)
class Kept:
    """A metric table: how it is built from sales, and the columns that name its groups."""

    build: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]

    @property
    def monthly(self) -> bool:
        return set(MONTH) <= set(self.keys)


_AREA, _SERIES = ("area_name_en",), ("area_name_en", "property_type")
TABLES = {
    "metrics_area": Kept(metrics.area_metrics, _AREA),
    "metrics_area_developers": Kept(lambda s: name_rows(s, ["area_name_en"], "developer"), _AREA),
    "metrics_monthly_trends": Kept(metrics.monthly_trends, metrics.MONTH_KEYS),
    "metrics_monthly_trend_ids": Kept(lambda s: metrics.monthly_members(s, metrics.monthly_trends(s, with_median=False)), metrics.MONTH_KEYS),
    # A change looks back within its series, so the series is the group.
    "metrics_price_changes": Kept(lambda s: metrics.month_over_month(metrics.monthly_trends(s, with_median=False)), _SERIES),
    "metrics_yoy_comparison": Kept(lambda s: metrics.year_over_year(metrics.monthly_trends(s, with_median=False)), _SERIES),
    "metrics_property_types": Kept(metrics.property_type_metrics, (*_SERIES, "rooms_en")),
    "metrics_luxury": Kept(metrics.luxury_monthly, (*_AREA, *MONTH)),
    "metrics_luxury_summary": Kept(metrics.luxury_summary, _AREA),
    "metrics_projects": Kept(metrics.project_metrics, ("project_name_en", "developer", "area_name_en", "transaction_type")),
    "metrics_developers": Kept(metrics.developer_metrics, ("developer",)),
    "metrics_offplan": Kept(metrics.offplan_monthly, (*_AREA, *MONTH, "transaction_type")),
    "metrics_offplan_comparison": Kept(metrics.offplan_comparison, _AREA),
}


def _write_months(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)


def start(sales: DataFrame, folder: str) -> None:
    """Builds every table below a folder from all sales."""
    sales = shared(sales)
    for name, table in TABLES.items():
        if table.monthly:
            _write_months(table.build(sales), f"{folder}/{name}")
        else:
            commit_table(table.build(sales), f"{folder}/{name}")


def refresh(sales: DataFrame, added: DataFrame, folder: str) -> None:
    """Brings every table up to date. `sales` are all sales with the added ones in; `added` only tells the groups.

    Of the sales only the years of the added ones are read for the tables by month. Groups only grow, so a month never
    loses its rows. A refresh that fails can be run again.
    """
    spark, added = sales.sparkSession, shared(added)
    years = [r[0] for r in added.select("transaction_year").distinct().collect()]  # as many as there are years
    months = added.select(*MONTH).distinct()
    in_months = shared(join_on(sales.where(F.col("transaction_year").isin(years)), months, list(MONTH), "left_semi"))
    for name, table in TABLES.items():
        path = f"{folder}/{name}"
        if table.monthly:
            _write_months(table.build(in_months), path)
            continue
        groups = added.select(*table.keys).distinct()
        anew = table.build(join_on(sales, groups, table.keys, "left_semi"))
        commit_table(join_on(read_table(spark, path), groups, table.keys, "left_anti").unionByName(anew), path)


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it now is."""
    return spark.read.parquet(f"{folder}/{name}") if TABLES[name].monthly else read_table(spark, f"{folder}/{name}")
