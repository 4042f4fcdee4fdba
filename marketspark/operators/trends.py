"""Momentum, seasonality and market cycle of every scope in one job.

A scope is the value of the given key columns: an area, an area and property type, or no key for the
whole market. Series are aggregated to months or quarters first, so that each scope has at most a few
dozen rows before any window runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.functions.expr import month_start, pct_change, quarter_start, ratio, rows
from marketspark.functions.periods import months_after, within
from marketspark.functions.scale import join_on
from marketspark.operators.metrics import PRICE

# Seasonal pattern assumed for a scope with too little data, and month names.
DEFAULT_PEAK_MONTHS = ("March", "October")
DEFAULT_LOW_MONTHS = ("July", "August")
DEFAULT_PEAK_RATIO = 1.3
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _scope(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(list(keys) or [F.lit(0)]))


def last_whole_end(as_of: date, months: int = 1) -> date:
    """The day after the last month (or quarter, months=3) that is over at the end of `as_of`."""
    after = as_of + timedelta(days=1)
    first = (after.month - 1) // months * months + 1
    return date(after.year, first, 1)


def _recent(df: DataFrame, as_of: date, months: int, unit: int, whole: bool) -> DataFrame:
    """Sales of the last `months` months: whole months or quarters only, or the days up to `as_of`."""
    if not whole:
        day = F.col("instance_date")
        return df.where((day <= F.lit(as_of)) & (day >= F.add_months(F.lit(as_of), -months)))
    end = last_whole_end(as_of, unit)
    return df.where(within(months_after(end, -months), end))


def monthly_series(df: DataFrame, keys: Sequence[str], as_of: date, months: int = 13, whole: bool = True) -> DataFrame:
    """Sales and price per month of the last whole months; a month still running would be compared with full ones."""
    return _recent(df, as_of, months, 1, whole).groupBy(*keys, month_start("instance_date").alias("month")).agg(
        rows().alias("tx_count"), F.avg(PRICE).alias("avg_price")
    )


def _placed(series: DataFrame, keys: Sequence[str], align: str) -> DataFrame:
    """Months numbered from the newest: by row, or by calendar so that a gap stays a gap."""
    if align == "rows":
        return series.withColumn("place", F.row_number().over(_scope(keys).orderBy(F.desc("month"))))
    if align != "calendar":
        raise ValueError(f"unknown alignment: {align}")
    newest = F.max("month").over(_scope(keys))
    return series.withColumn("place", (F.months_between(newest, "month") + 1).cast("int"))


def _at(place: int, column: str) -> Column:
    return F.max(F.when(F.col("place") == place, F.col(column)))


def price_momentum(
    df: DataFrame, keys: Sequence[str], as_of: date, min_rows: int = 10, align: str = "rows", whole: bool = True
) -> DataFrame:
    """Price change over 3, 6 and 12 months with trajectory and consistency, per scope."""
    series = monthly_series(df, keys, as_of, whole=whole)
    scopes = series.select(*keys).distinct() if keys else series.agg(rows().alias("__n")).select(F.lit(1).alias("__n")).drop("__n")
    placed = _placed(series.where(F.col("tx_count") >= min_rows), keys, align)
    older = F.lead("avg_price").over(_scope(keys).orderBy("place"))
    changes = placed.withColumn("change", F.when(older > 0, (F.col("avg_price") - older) / older)).withColumn(
        "row", F.row_number().over(_scope(keys).orderBy("place"))
    )
    change, row = F.col("change"), F.col("row")
    summary = changes.groupBy(*keys).agg(
        rows().alias("months"),
        _at(1, "avg_price").alias("newest"),
        _at(4, "avg_price").alias("back_3"),
        _at(7, "avg_price").alias("back_6"),
        _at(13, "avg_price").alias("back_12"),
        F.count("change").alias("n_changes"),
        F.count_if(change > 0.01).alias("rising"),
        F.count_if(change < -0.01).alias("falling"),
        F.avg(F.when(row <= 3, change)).alias("recent"),
        F.avg(F.when((row > 3) & (row <= 6), change)).alias("older"),
    )
    total, rising, falling = F.col("n_changes"), F.col("rising"), F.col("falling")
    neutral = total - rising - falling
    too_few = (F.col("months") < 4) | (total == 0)
    mostly_rising, mostly_falling = rising >= total * 0.7, falling >= total * 0.7
    one_sided = F.abs(rising - falling) > total * 0.5
    speeding_up = F.col("recent") > F.coalesce("older", "recent") * 1.2
    trajectory = (
        F.when(too_few, "stable")
        .when(mostly_rising & speeding_up, "accelerating")
        .when(mostly_rising, "stable")
        .when(mostly_falling, "decelerating")
        .when(one_sided, "volatile")
        .otherwise("stable")
    )
    consistency = (
        F.when(too_few, 0.0)
        .when(mostly_rising, ratio(rising, total))
        .when(mostly_falling, ratio(falling, total))
        .when(one_sided, 0.3)
        .otherwise(ratio(neutral, total))
    )
    known = F.col("months") >= 2
    result = summary.select(
        *keys,
        F.when(known, F.col("newest")).otherwise(0.0).alias("current_avg_price"),
        F.when(known, pct_change("newest", "back_3")).alias("momentum_3m"),
        F.when(known, pct_change("newest", "back_6")).alias("momentum_6m"),
        F.when(known, pct_change("newest", "back_12")).alias("momentum_12m"),
        trajectory.alias("trajectory"),
        consistency.alias("consistency_score"),
    )
    if not keys:
        return result
    filled = join_on(scopes, result, keys)
    return filled.fillna({"current_avg_price": 0.0, "trajectory": "stable", "consistency_score": 0.0})


def volume_momentum(df: DataFrame, keys: Sequence[str], as_of: date, align: str = "rows", whole: bool = True) -> DataFrame:
    """Change of monthly sales over 3, 6 and 12 months with a trend label, per scope."""
    placed = _placed(monthly_series(df, keys, as_of, whole=whole), keys, align)
    summary = placed.groupBy(*keys).agg(
        rows().alias("months"),
        _at(1, "tx_count").alias("newest"),
        _at(4, "tx_count").alias("back_3"),
        _at(7, "tx_count").alias("back_6"),
        _at(13, "tx_count").alias("back_12"),
    )
    known = F.col("months") >= 2
    change = pct_change("newest", "back_3")
    trend = F.when(~known, "insufficient_data").when(change > 15, "increasing").when(change < -15, "decreasing")
    return summary.select(
        *keys,
        F.when(known, F.col("newest")).otherwise(0).alias("current_monthly_volume"),
        F.when(known, change).alias("volume_3m_change"),
        F.when(known, pct_change("newest", "back_6")).alias("volume_6m_change"),
        F.when(known, pct_change("newest", "back_12")).alias("volume_12m_change"),
        trend.otherwise("stable").alias("volume_trend"),
    )


def month_indices(df: DataFrame, keys: Sequence[str], start: date, as_of: date) -> DataFrame:
    """Sales of each calendar month in a mean year, relative to the average month of the scope (100).

    Only months that are over at `as_of` and began at `start` or later count, and each calendar month is divided
    by how often it occurs among them.
    """
    first, end = last_whole_end(start - timedelta(days=1)), last_whole_end(as_of)
    if first < start:
        first = months_after(first, 1)
    total = max(0, (end.year - first.year) * 12 + end.month - first.month)
    often = [len(range((m - first.month) % 12, total, 12)) for m in range(1, 13)]
    counted = df.where(within(first, end)).groupBy(*keys, F.month("instance_date").alias("month_number")).agg(rows().alias("tx_count"))
    yearly = F.col("tx_count") / F.element_at(F.array(*[F.lit(n) for n in often]), F.col("month_number"))
    return counted.withColumn("month_index", yearly / F.avg(yearly).over(_scope(keys)) * 100)


def seasonality(df: DataFrame, keys: Sequence[str], start: date, as_of: date) -> DataFrame:
    """Peak and low months of every scope and where the month of `as_of` stands."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    ranked = month_indices(df, keys, start, as_of).withColumn("month_name", F.element_at(names, F.col("month_number"))).withColumn(
        "place", F.row_number().over(_scope(keys).orderBy(F.desc("month_index"), "month_number"))
    )
    from_last = F.count(F.lit(1)).over(_scope(keys)) - F.col("place")
    ranked = ranked.withColumn("from_last", from_last)
    peak, low = F.col("place") <= 3, F.col("from_last") < 3

    def listed(condition: Column) -> Column:
        # At most three months per scope meet the condition.
        picked = F.array_sort(F.collect_list(F.when(condition, F.struct("place", "month_name"))))
        return F.array_join(F.transform(picked, lambda s: s["month_name"]), ", ")

    summary = ranked.groupBy(*keys).agg(
        rows().alias("months"),
        listed(peak).alias("peak"),
        listed(low).alias("low"),
        F.avg(F.when(peak, F.col("month_index"))).alias("peak_avg"),
        F.avg(F.when(low, F.col("month_index"))).alias("low_avg"),
        F.max(F.when(F.col("month_number") == as_of.month, F.col("month_index"))).alias("this_month"),
    )
    enough = F.col("months") >= 6
    index = F.coalesce("this_month", F.lit(100.0))
    position = F.when(enough & (index >= 110), "peak").when(enough & (index <= 90), "low").otherwise("normal")
    return summary.select(
        *keys,
        F.when(enough, F.col("peak")).otherwise(", ".join(DEFAULT_PEAK_MONTHS)).alias("peak_months"),
        F.when(enough, F.col("low")).otherwise(", ".join(DEFAULT_LOW_MONTHS)).alias("low_months"),
        F.when(enough, F.coalesce(F.try_divide("peak_avg", "low_avg"), F.lit(1.0))).otherwise(DEFAULT_PEAK_RATIO).alias("peak_vs_low_ratio"),
        position.alias("current_month_position"),
    )


def market_cycle(df: DataFrame, keys: Sequence[str], as_of: date, months: int = 24, whole: bool = True) -> DataFrame:
    """Phase of the market cycle of every scope over whole quarters, with confidence and how long it has lasted."""
    series = _recent(df, as_of, months, 3, whole).groupBy(*keys, quarter_start("instance_date").alias("quarter")).agg(
        rows().alias("tx_count"), F.avg(PRICE).alias("avg_price")
    )
    order = _scope(keys).orderBy(F.desc("quarter"))
    old_price, old_count = F.lead("avg_price").over(order), F.lead("tx_count").over(order)
    changes = series.withColumns(
        {
            "place": F.row_number().over(order),
            "price_change": F.when(old_price > 0, (F.col("avg_price") - old_price) / old_price),
            "volume_change": F.when(old_count > 0, (F.col("tx_count") - old_count) / old_count),
        }
    )
    recent = F.col("place") <= 2
    # The mean of the two newest changes is needed on every row to see where its sign breaks off.
    changes = changes.withColumn("trend", F.avg(F.when(recent, F.col("price_change"))).over(_scope(keys)))
    keeps = (F.signum("price_change") == F.signum("trend")) & (F.signum("trend") != 0)
    breaks = (F.col("place") >= 2) & F.col("price_change").isNotNull() & ~keeps
    summary = changes.groupBy(*keys).agg(
        rows().alias("quarters"),
        F.count("price_change").alias("n_changes"),
        F.max("trend").alias("price_trend"),
        F.avg(F.when(recent, F.col("volume_change"))).alias("volume_trend"),
        F.min(F.when(breaks, F.col("place"))).alias("break_place"),
    )
    price, volume = F.coalesce("price_trend", F.lit(0.0)), F.coalesce("volume_trend", F.lit(0.0))
    enough = F.col("quarters") >= 3
    growth, peak = (price > 0.03) & (volume > 0.05), (price > 0.02) & (volume < -0.05)
    correction, recovery = price < -0.02, (price > 0) & (volume > 0.1)
    phase = (
        F.when(~enough, "stable").when(growth, "growth").when(peak, "peak").when(correction, "correction")
        .when(recovery, "recovery").otherwise("stable")
    )
    confidence = (
        F.when(~enough, 0.3)
        .when(growth, F.least(F.lit(0.9), 0.5 + F.abs(price) + F.abs(volume)))
        .when(peak, 0.6)
        .when(correction, F.least(F.lit(0.8), 0.5 + F.abs(price)))
        .when(recovery, 0.6)
        .otherwise(0.5)
    )
    run = F.coalesce(F.col("break_place"), F.greatest(F.col("n_changes") + 1, F.lit(2))) - 1
    return summary.select(
        *keys,
        phase.alias("phase"),
        confidence.alias("phase_confidence"),
        F.when(enough, run * 3).otherwise(0).cast("int").alias("phase_duration_months"),
        F.when(enough, price * 100).alias("recent_price_trend_qoq"),
        F.when(enough, volume * 100).alias("recent_volume_trend_qoq"),
        F.col("quarters").alias("quarters_analyzed"),
    )


def combined_trends(df: DataFrame, keys: Sequence[str], as_of: date, season_start: date, min_rows: int = 10) -> DataFrame:
    """Price and volume momentum, seasonality and cycle of every scope in one row."""
    parts = [
        volume_momentum(df, keys, as_of),
        seasonality(df, keys, season_start, as_of),
        market_cycle(df, keys, as_of),
    ]
    out = price_momentum(df, keys, as_of, min_rows)
    for part in parts:
        out = join_on(out, part, keys)
    return out
