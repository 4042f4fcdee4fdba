"""Precomputed metric tables and the window derivations on them.

All take verified sales (or a metric table) and return a DataFrame; sinks.replace_table stores it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.functions.expr import avg_where, band, count_where, filled, pct_change, rows, share
from marketspark.functions.scale import Quantile, join_on, name_list, ordered_members, summarise

PRICE = "actual_worth"
SQM = "meter_sale_price"


MEDIAN = Quantile("median_price", PRICE, 0.5)
QUARTILES = (Quantile("price_q1", PRICE, 0.25), Quantile("price_q3", PRICE, 0.75))


def offplan(column: str = "transaction_type") -> Column:
    return F.col(column) == "Off-Plan"


def ready(column: str = "transaction_type") -> Column:
    return F.col(column) == "Existing"


def average(c: str, name: str) -> Column:
    return F.avg(c).alias(name)


def _price_spread() -> list[Column]:
    return [F.min(PRICE).alias("min_price"), F.max(PRICE).alias("max_price")]


def area_metrics(df: DataFrame, min_rows: int = 10) -> DataFrame:
    keys = ["area_name_en"]
    table = summarise(
        df,
        keys,
        [
            rows().alias("total_transactions"),
            average(PRICE, "avg_price"),
            *_price_spread(),
            average(SQM, "avg_price_sqm"),
            average("procedure_area", "avg_size_sqm"),
            count_where(F.col("is_luxury")).alias("luxury_count"),
            count_where(offplan()).alias("offplan_count"),
            F.max("transaction_year").alias("last_transaction_year"),
        ],
        [MEDIAN],
        distinct={"property_types": "property_type", "unique_projects": "project_name_en"},
    ).where(F.col("total_transactions") >= min_rows)
    return join_on(table, name_list(df, keys, "developer", "top_developers"), keys)


def area_metrics_public(df: DataFrame, from_year: int = 2020, min_rows: int = 10) -> DataFrame:
    """Area metrics of the public feed: recent sales only, with nearby metro stations and malls."""
    sales = df.where((F.col("trans_group_en") == "Sales") & (F.col("transaction_year") >= from_year))
    keys = ["area_name_en"]
    table = summarise(
        sales,
        keys,
        [
            rows().alias("total_transactions"),
            average(PRICE, "avg_price"),
            *_price_spread(),
            average(SQM, "avg_price_sqm"),
            average("procedure_area", "avg_size_sqm"),
            count_where(F.col("is_luxury")).alias("luxury_count"),
            F.max("transaction_year").alias("last_transaction_year"),
        ],
        [MEDIAN],
        distinct={"property_types": "property_type_en"},
    ).where(F.col("total_transactions") >= min_rows)
    table = join_on(table, name_list(sales, keys, "nearest_metro_en", "nearby_metros"), keys)
    return join_on(table, name_list(sales, keys, "nearest_mall_en", "nearby_malls"), keys)


MONTH_KEYS = ("area_name_en", "transaction_year", "transaction_month", "property_type")


def monthly_trends(df: DataFrame, min_rows: int = 3, with_median: bool = True, keys: Sequence[str] = MONTH_KEYS) -> DataFrame:
    aggregates = [rows().alias("tx_count"), average(PRICE, "avg_price"), average(SQM, "avg_price_sqm")]
    if with_median:
        aggregates.append(count_where(offplan()).alias("offplan_count"))
    table = summarise(df, list(keys), aggregates, [MEDIAN] if with_median else [], by_size=True)
    return table.where(F.col("tx_count") >= min_rows)


def monthly_members(df: DataFrame, trends: DataFrame, keys: Sequence[str] = MONTH_KEYS) -> DataFrame:
    """Ids behind every row of the monthly trends, dearest first, as numbered rows.

    Rows rather than one text value, so that a group of any length is whole.
    """
    kept = trends.select(*keys)
    members = df.select(*keys, "transaction_id", PRICE).join(kept, list(keys), "left_semi")
    return ordered_members(members, list(keys), PRICE, "transaction_id")


def property_type_metrics(df: DataFrame, min_rows: int = 5) -> DataFrame:
    return summarise(
        df,
        ["area_name_en", "property_type", "rooms_en"],
        [
            rows().alias("tx_count"),
            average(PRICE, "avg_price"),
            average(SQM, "avg_price_sqm"),
            average("procedure_area", "avg_size_sqm"),
            *_price_spread(),
        ],
        [MEDIAN, *QUARTILES],
    ).where(F.col("tx_count") >= min_rows)


def property_type_metrics_public(
    df: DataFrame, kind: str = "Unit", from_year: int = 2020, min_rows: int = 5
) -> DataFrame:
    sales = df.where(
        (F.col("trans_group_en") == "Sales") & (F.col("transaction_year") >= from_year) & (F.col("property_type_en") == kind)
    )
    return summarise(
        sales,
        ["area_name_en", "property_type_en", "rooms_en"],
        [
            rows().alias("tx_count"),
            average(PRICE, "avg_price"),
            average(SQM, "avg_price_sqm"),
            average("procedure_area", "avg_size_sqm"),
        ],
        QUARTILES,
    ).where(F.col("tx_count") >= min_rows)


def luxury_monthly(df: DataFrame, min_rows: int = 3) -> DataFrame:
    keys = ["area_name_en", "transaction_year", "transaction_month"]
    sales = df.where("is_luxury")
    table = summarise(
        sales,
        keys,
        [
            rows().alias("luxury_tx_count"),
            average(PRICE, "avg_luxury_price"),
            F.min(PRICE).alias("min_luxury_price"),
            F.max(PRICE).alias("max_luxury_price"),
        ],
        [Quantile("median_luxury_price", PRICE, 0.5)],
        by_size=True,
    ).where(F.col("luxury_tx_count") >= min_rows)
    table = join_on(table, name_list(sales, keys, "project_name_en", "luxury_projects"), keys)
    return join_on(table, name_list(sales, keys, "developer", "luxury_developers"), keys)


def luxury_yearly(df: DataFrame, from_year: int = 2020, min_rows: int = 3) -> DataFrame:
    keys = ["area_name_en", "transaction_year"]
    sales = df.where(F.col("is_luxury") & (F.col("transaction_year") >= from_year))
    table = (
        sales.groupBy(*keys)
        .agg(
            rows().alias("luxury_tx_count"),
            average(PRICE, "avg_luxury_price"),
            F.min(PRICE).alias("min_luxury_price"),
            F.max(PRICE).alias("max_luxury_price"),
        )
        .where(F.col("luxury_tx_count") >= min_rows)
    )
    return join_on(table, name_list(sales, keys, "project_name_en", "luxury_projects"), keys)


def luxury_summary(df: DataFrame, min_rows: int = 5) -> DataFrame:
    table = summarise(
        df.where("is_luxury"),
        ["area_name_en"],
        [
            rows().alias("total_luxury_transactions"),
            average(PRICE, "avg_luxury_price"),
            F.max(PRICE).alias("highest_sale"),
            average(SQM, "avg_price_sqm"),
        ],
        distinct={"luxury_projects_count": "project_name_en", "luxury_developers_count": "developer"},
    )
    return table.where(F.col("total_luxury_transactions") >= min_rows)


def project_metrics(df: DataFrame, min_rows: int = 5) -> DataFrame:
    keys = ["project_name_en", "developer", "area_name_en", "transaction_type"]
    sales = df.where(filled("project_name_en"))
    table = summarise(
        sales,
        keys,
        [
            rows().alias("tx_count"),
            average(PRICE, "avg_price"),
            average(SQM, "avg_price_sqm"),
            F.min("instance_date").alias("first_sale_date"),
            F.max("instance_date").alias("last_sale_date"),
            count_where(F.col("is_luxury")).alias("luxury_units"),
        ],
        [MEDIAN],
        by_size=True,
    ).where(F.col("tx_count") >= min_rows)
    return join_on(table, name_list(sales, keys, "rooms_en", "unit_types_available"), keys)


def project_metrics_public(df: DataFrame, from_year: int = 2020, min_rows: int = 5) -> DataFrame:
    sales = df.where(
        (F.col("trans_group_en") == "Sales")
        & F.col("project_name_en").isNotNull()
        & (F.col("project_name_en") != "Not Applicable")
        & (F.col("transaction_year") >= from_year)
    )
    return (
        sales.groupBy("project_name_en", "master_project_en", "area_name_en", "reg_type_en")
        .agg(
            rows().alias("tx_count"),
            average(PRICE, "avg_price"),
            F.min("transaction_year").alias("first_sale_year"),
            F.max("transaction_year").alias("last_sale_year"),
            count_where(F.col("is_luxury")).alias("luxury_units"),
        )
        .where(F.col("tx_count") >= min_rows)
    )


def developer_metrics(df: DataFrame, min_rows: int = 10) -> DataFrame:
    return summarise(
        df.where(filled("developer")),
        ["developer"],
        [
            rows().alias("total_transactions"),
            average(PRICE, "avg_price"),
            F.sum(PRICE).alias("total_sales_volume"),
            count_where(F.col("is_luxury")).alias("luxury_units"),
            count_where(offplan()).alias("offplan_sales"),
            F.min("instance_date").alias("first_sale_date"),
            F.max("instance_date").alias("last_sale_date"),
        ],
        [MEDIAN],
        distinct={"areas_active": "area_name_en", "projects_count": "project_name_en"},
        by_size=True,
    ).where(F.col("total_transactions") >= min_rows)


def offplan_monthly(df: DataFrame, min_rows: int = 3) -> DataFrame:
    return summarise(
        df,
        ["area_name_en", "transaction_year", "transaction_month", "transaction_type"],
        [rows().alias("tx_count"), average(PRICE, "avg_price"), average(SQM, "avg_price_sqm")],
        [MEDIAN],
        by_size=True,
    ).where(F.col("tx_count") >= min_rows)


def offplan_comparison(df: DataFrame, min_rows: int = 20) -> DataFrame:
    return (
        df.groupBy("area_name_en")
        .agg(
            rows().alias("__rows"),
            count_where(offplan()).alias("offplan_count"),
            count_where(ready()).alias("ready_count"),
            avg_where(offplan(), PRICE).alias("avg_offplan_price"),
            avg_where(ready(), PRICE).alias("avg_ready_price"),
        )
        .where(F.col("__rows") >= min_rows)
        .withColumn("offplan_percentage", share("offplan_count", "__rows"))
        .drop("__rows")
    )


def market_overview(df: DataFrame) -> DataFrame:
    """One row of market-wide measures."""
    return summarise(
        df,
        [],
        [
            rows().alias("total_transactions"),
            F.min("instance_date").alias("earliest_date"),
            F.max("instance_date").alias("latest_date"),
            average(PRICE, "avg_price"),
            F.sum(PRICE).alias("total_market_volume"),
            count_where(F.col("is_luxury")).alias("luxury_count"),
            count_where(offplan()).alias("offplan_count"),
        ],
        [MEDIAN],
        distinct={"unique_areas": "area_name_en", "unique_projects": "project_name_en", "unique_developers": "developer"},
    )


def trend_rollup(trends: DataFrame, keys: Sequence[str], year: int | None = None, property_type: str | None = None) -> DataFrame:
    """Monthly trends rolled up to fewer keys: counts added, averages unweighted and weighted."""
    if year is not None:
        trends = trends.where(F.col("transaction_year") == year)
    if property_type is not None:
        trends = trends.where(F.col("property_type") == property_type)
    weighted = F.try_divide(F.sum(F.col("avg_price") * F.col("tx_count")), F.sum("tx_count"))
    return trends.groupBy(*keys).agg(
        F.sum("tx_count").alias("tx_count"),
        average("avg_price", "avg_price"),
        average("avg_price_sqm", "avg_price_sqm"),
        weighted.alias("weighted_avg_price"),
    )


def month_snapshot(trends: DataFrame, luxury_areas: DataFrame, year: int, month: int) -> DataFrame:
    """One month of the trends by area, with the share of sales made in areas that have luxury sales."""
    named = luxury_areas.select("area_name_en", F.lit(True).alias("in_luxury_area"))
    month_rows = trends.where((F.col("transaction_year") == year) & (F.col("transaction_month") == month))
    flagged = join_on(month_rows, named, ["area_name_en"])
    in_luxury = F.coalesce(F.col("in_luxury_area"), F.lit(False))
    return flagged.agg(
        F.sum("tx_count").alias("tx_count"),
        F.countDistinct("area_name_en").alias("areas"),
        average("avg_price", "avg_price"),
        F.coalesce(F.sum(F.when(in_luxury, F.col("tx_count"))), F.lit(0)).alias("luxury_area_tx"),
    )


def top_areas_of_month(trends: DataFrame, year: int, month: int, limit: int = 10) -> DataFrame:
    month_rows = trends.where((F.col("transaction_year") == year) & (F.col("transaction_month") == month))
    return (
        month_rows.groupBy("area_name_en")
        .agg(F.sum("tx_count").alias("tx_count"), average("avg_price", "avg_price"))
        .orderBy(F.desc("tx_count"), "area_name_en")
        .limit(limit)
    )


def month_over_month(trends: DataFrame) -> DataFrame:
    """Price change against the area's and type's previous row; months without a row are skipped."""
    order = Window.partitionBy("area_name_en", "property_type").orderBy("transaction_year", "transaction_month")
    return trends.select(
        *MONTH_KEYS,
        "avg_price",
        "tx_count",
        F.lag("avg_price").over(order).alias("prev_month_price"),
        F.lag("tx_count").over(order).alias("prev_month_tx_count"),
    ).withColumn("pct_change_mom", pct_change("avg_price", "prev_month_price"))


def year_over_year(trends: DataFrame) -> DataFrame:
    order = Window.partitionBy("area_name_en", "property_type").orderBy("transaction_year")
    yearly = trends.groupBy("area_name_en", "transaction_year", "property_type").agg(
        F.sum("tx_count").alias("total_transactions"),
        average("avg_price", "avg_price"),
        average("avg_price_sqm", "avg_price_sqm"),
    )
    return yearly.withColumns(
        {
            "prev_year_transactions": F.lag("total_transactions").over(order),
            "prev_year_price": F.lag("avg_price").over(order),
        }
    )


def with_total(df: DataFrame, measure: str, total: str) -> DataFrame:
    """Adds the sum of a measure over all rows, as a scalar of the plan rather than a window of one task."""
    return df.withColumn(total, df.agg(F.sum(measure)).scalar())


def mix(df: DataFrame, by: str | Column, name: str) -> DataFrame:
    """Rows, volume and average by one attribute, with the share of all rows."""
    key = F.col(by) if isinstance(by, str) else by
    grouped = df.groupBy(key.alias(name)).agg(
        rows().alias("tx_count"), F.sum(PRICE).alias("volume"), average(PRICE, "avg_price"), average(SQM, "avg_price_sqm")
    )
    return with_total(grouped, "tx_count", "__total").withColumn("pct", share("tx_count", "__total")).drop("__total")


def mix_within(df: DataFrame, scope: str, by: str | Column, name: str) -> DataFrame:
    """Rows by one attribute with their share within each scope."""
    key = F.col(by) if isinstance(by, str) else by
    grouped = df.groupBy(scope, key.alias(name)).agg(rows().alias("tx_count"))
    total = F.sum("tx_count").over(Window.partitionBy(scope))
    return grouped.withColumn("pct", share("tx_count", total))


def band_samples(
    df: DataFrame, edges: Sequence[float], labels: Sequence[str], also_by: Sequence[str] = (), per_group: int = 2, limit: int = 8
) -> DataFrame:
    """The dearest sales of each price band of each area, then the dearest of those per area."""
    banded = df.withColumn("price_category", band(PRICE, edges, labels))
    order = [F.desc(PRICE), F.col("transaction_id")]
    groups = Window.partitionBy("area_name_en", "price_category", *also_by).orderBy(*order)
    area = Window.partitionBy("area_name_en").orderBy(*order)
    kept = banded.withColumn("band_rank", F.row_number().over(groups)).where(F.col("band_rank") <= per_group)
    return kept.withColumn("area_rank", F.row_number().over(area)).where(F.col("area_rank") <= limit)


def numbered(top: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank numbers for an already limited top list."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))
