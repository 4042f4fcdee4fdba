"""Unusual sales, areas and developers of a period. Current and past activity come from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.functions.expr import count_where, filled, pct_change, sum_where
from marketspark.functions.periods import Period, within
from marketspark.operators.metrics import PRICE, numbered


def record_sales(df: DataFrame, period: Period, limit: int = 10, min_price: float | None = None) -> DataFrame:
    """The dearest sales of a period, optionally only those from a price on."""
    sales = df.where(period.contains())
    if min_price is not None:
        sales = sales.where(F.col(PRICE) >= min_price)
    order = (F.desc(PRICE), F.col("transaction_id"))
    return numbered(sales.orderBy(*order).limit(limit), *order)


def ultra_luxury_records(df: DataFrame, period: Period, min_price: float = 10_000_000, limit: int = 5) -> DataFrame:
    return record_sales(df, period, limit, min_price)


def activity_shift(df: DataFrame, key: str, period: Period, lookback_months: int = 12, per_month: bool = True) -> DataFrame:
    """Sales of a period against the monthly average of the months before it, per key.

    per_month compares a month's worth of the period with a month; without it a quarter is compared
    with a month as a whole.
    """
    start, end = period.lookback(lookback_months)
    now, before = period.contains(), within(start, end)
    months = float(period.months) if per_month else 1.0
    counted = df.where(now | before).groupBy(key).agg(
        count_where(now).alias("current_count"),
        sum_where(now, PRICE).alias("current_value"),
        (count_where(before) / F.lit(float(lookback_months))).alias("historical_monthly_avg"),
    )
    rate = F.col("current_count") / F.lit(months)
    return counted.withColumn("change_pct", pct_change(rate, "historical_monthly_avg"))


def volume_spikes(
    df: DataFrame, period: Period, lookback_months: int = 12, threshold: float = 30.0, min_baseline: float = 5.0,
    limit: int = 10, per_month: bool = True,
) -> DataFrame:
    """Areas far above their usual activity."""
    shift = activity_shift(df, "area_name_en", period, lookback_months, per_month)
    busy = (F.col("historical_monthly_avg") > min_baseline) & (F.col("current_count") > 0)
    return shift.where(busy & (F.col("change_pct") >= threshold)).orderBy(F.desc("change_pct"), "area_name_en").limit(limit)


def volume_drops(
    df: DataFrame, period: Period, lookback_months: int = 12, threshold: float = -30.0, min_baseline: float = 10.0,
    limit: int = 10, per_month: bool = True,
) -> DataFrame:
    """Areas far below their usual activity, including those without any sale in the period."""
    shift = activity_shift(df, "area_name_en", period, lookback_months, per_month)
    busy = F.col("historical_monthly_avg") > min_baseline
    return shift.where(busy & (F.col("change_pct") <= threshold)).orderBy("change_pct", "area_name_en").limit(limit)


def new_developers(
    df: DataFrame, period: Period, lookback_months: int = 12, min_rows: int = 5, limit: int = 10
) -> DataFrame:
    """Developers whose first sale lies in the lookback or the period, with their sales in the period."""
    start, _ = period.lookback(lookback_months)
    now = period.contains()
    known = df.where(filled("developer")).groupBy("developer").agg(
        F.min("instance_date").alias("first_sale_date"),
        count_where(now).alias("transaction_count"),
        sum_where(now, PRICE).alias("total_value"),
        F.countDistinct(F.when(now, F.col("area_name_en"))).alias("areas_active"),
    )
    recent = (F.col("first_sale_date") >= F.lit(start)) & (F.col("transaction_count") >= min_rows)
    return known.where(recent).orderBy(F.desc("transaction_count"), "developer").limit(limit)


def developer_surges(
    df: DataFrame, period: Period, lookback_months: int = 12, threshold: float = 50.0, min_baseline: float = 10.0,
    limit: int = 10, per_month: bool = True,
) -> DataFrame:
    """Established developers far above their usual activity."""
    shift = activity_shift(df.where(filled("developer")), "developer", period, lookback_months, per_month)
    busy = (F.col("historical_monthly_avg") >= min_baseline) & (F.col("current_count") > 0)
    return shift.where(busy & (F.col("change_pct") >= threshold)).orderBy(F.desc("change_pct"), "developer").limit(limit)


def months_before(day: Column | str, months: int) -> Column:
    """The same day some months earlier, or the last of that month where it has no such day."""
    return F.add_months(day, -months)
