"""Series behind charts, always over clean sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.functions.expr import band, count_where, filled, pct_change, quarter_start, rows, share, sum_where
from marketspark.functions.periods import Period
from marketspark.operators.metrics import PRICE, numbered, offplan, ready

METRICS = ("transaction_count", "total_volume", "avg_price")


def _measures() -> list[Column]:
    return [rows().alias("transaction_count"), F.sum(PRICE).alias("total_volume"), F.avg(PRICE).alias("avg_price")]


def in_segment(df: DataFrame, segment: str | None) -> DataFrame:
    if segment is None:
        return df
    conditions = {"luxury": F.col("is_luxury"), "offplan": offplan(), "ready": ready()}
    return df.where(conditions[segment])


def in_period(df: DataFrame, year: int | None = None, quarter: int | None = None) -> DataFrame:
    if year is None:
        return df
    period = Period(year, "annual") if quarter is None else Period(year, "quarterly", quarter)
    return df.where(period.contains())


def monthly_trend(df: DataFrame, year: int, segment: str | None = None) -> DataFrame:
    return in_segment(in_period(df, year), segment).groupBy("transaction_month").agg(*_measures())


def quarter_against_previous(df: DataFrame, year: int, quarter: int) -> DataFrame:
    """Monthly series of a quarter and of the one before, across the turn of the year."""
    period = Period(year, "quarterly", quarter)
    previous = period.previous()
    label = F.when(period.contains(), f"Q{quarter} {year}").otherwise(f"Q{previous.number} {previous.year}")
    return (
        df.where(period.contains() | previous.contains())
        .groupBy(label.alias("quarter_label"), "transaction_month")
        .agg(*_measures())
    )


def top_names(
    df: DataFrame, name: str, metric: str = "transaction_count", limit: int = 10,
    year: int | None = None, quarter: int | None = None, segment: str | None = None,
) -> DataFrame:
    """Leading areas or developers by count, volume or average price."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    sales = in_segment(in_period(df, year, quarter), segment).where(filled(name))
    order = (F.desc(metric), F.col("name"))
    grouped = sales.groupBy(F.col(name).alias("name")).agg(*_measures())
    return numbered(grouped.orderBy(*order).limit(limit), *order)


def segment_mix(df: DataFrame, segment: Column) -> DataFrame:
    """Sales per segment of one dimension: sale type, price tier or property type."""
    return df.groupBy(segment.alias("segment")).agg(rows().alias("tx_count")).where(F.col("segment").isNotNull())


def price_tier(edges: Sequence[float], labels: Sequence[str] = ("Standard", "Mid-Range", "Luxury", "Ultra Luxury")) -> Column:
    return band(PRICE, edges, labels)


def price_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins between the lowest and highest price; the last bin includes its upper edge."""
    prices = df.where(F.col(PRICE) > 0)
    bounds = prices.agg(F.min(PRICE).alias("low"), F.max(PRICE).alias("high"))
    edges = prices.agg(F.struct(F.min(PRICE).alias("low"), F.max(PRICE).alias("high"))).scalar()
    low, high = edges["low"], edges["high"]
    place = F.floor(F.try_divide(F.col(PRICE) - low, high - low) * bins) + 1
    number = F.coalesce(F.least(place, F.lit(bins)), F.lit(1)).cast("int")
    counted = prices.groupBy(number.alias("bin")).agg(rows().alias("tx_count"))
    all_bins = bounds.where(F.col("low").isNotNull()).select("low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (F.col("low") + width * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("low") + width * F.col("bin")).alias("bin_to"),
        F.coalesce("tx_count", F.lit(0)).alias("tx_count"),
    )


def two_year_overlay(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return df.where(F.col("transaction_year").isin(*years)).groupBy("transaction_year", "transaction_month").agg(
        rows().alias("tx_count"), sum_where(F.lit(True), PRICE).alias("volume"), count_where(F.col("is_luxury")).alias("luxury_count")
    )


def area_matrix(df: DataFrame, min_rows: int = 1000) -> DataFrame:
    grouped = df.groupBy("area_name_en").agg(
        rows().alias("tx_count"),
        F.avg(PRICE).alias("avg_price"),
        F.sum(PRICE).alias("total_value"),
        count_where(F.col("transaction_type").like("%Off%")).alias("offplan_count"),
    )
    return grouped.where(F.col("tx_count") >= min_rows).withColumn("offplan_pct", share("offplan_count", "tx_count"))


def quarterly_prices(df: DataFrame) -> DataFrame:
    return df.groupBy(quarter_start("instance_date").alias("quarter")).agg(
        F.avg(PRICE).alias("avg_price"), rows().alias("tx_count")
    )


def offplan_by_month(df: DataFrame) -> DataFrame:
    is_offplan = F.col("transaction_type").like("%Off%")
    return df.groupBy("transaction_year", "transaction_month").agg(
        count_where(is_offplan).alias("offplan_count"), count_where(~is_offplan).alias("ready_count")
    )


def series_facts(series: DataFrame, keys: Sequence[str], order: str, label: str, value: str) -> DataFrame:
    """What a chart's caption states: overall change, peak, leader, its lead over the second, its share.

    `series` holds aggregated points, so each key has as many rows as its chart has points.
    """
    position = F.struct(F.col(value), F.negate(order))
    ranked = series.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), order)))
    facts = ranked.groupBy(*keys).agg(
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
        F.max_by(label, position).alias("peak_label"),
        F.max(value).alias("peak_value"),
        F.max(F.when(F.col("__place") == 2, F.col(value))).alias("second_value"),
        F.sum(value).alias("total_value"),
    )
    return facts.withColumns(
        {
            "overall_change_pct": pct_change("last_value", "first_value"),
            "lead_margin_pct": pct_change("peak_value", "second_value"),
            "dominant_share_pct": share("peak_value", "total_value"),
        }
    )

