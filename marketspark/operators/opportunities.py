"""Growth, value and market-share opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import INFINITE_GROWTH
from marketspark.functions.expr import avg_where, count_where, filled, pct_change, rows, share, sum_where
from marketspark.functions.periods import Period, within
from marketspark.functions.scale import Quantile, lowest_in_range, range_sums, summarise
from marketspark.operators.metrics import PRICE, SQM, offplan


def _current_and_before(period: Period) -> tuple[Column, Column]:
    start, end = period.preceding_window()
    return period.contains(), within(start, end)


def emerging_hotspots(
    df: DataFrame, period: Period, min_rows: int = 20, min_before: int = 10, min_growth: float = 15.0, limit: int = 10
) -> DataFrame:
    """Areas growing in sales and in price against the equally long window before."""
    now, before = _current_and_before(period)
    grouped = (
        df.where(now | before)
        .groupBy("area_name_en")
        .agg(
            count_where(now).alias("current_tx"),
            count_where(before).alias("previous_tx"),
            avg_where(now, PRICE).alias("current_price"),
            avg_where(before, PRICE).alias("previous_price"),
        )
        .where((F.col("current_tx") >= min_rows) & (F.col("previous_tx") >= min_before))
        .withColumns(
            {"tx_growth": pct_change("current_tx", "previous_tx"), "price_growth": pct_change("current_price", "previous_price")}
        )
        .withColumn("momentum_score", F.col("tx_growth") * 0.6 + F.col("price_growth") * 0.4)
    )
    kept = grouped.where((F.col("tx_growth") >= min_growth) & (F.col("price_growth") > 0))
    return kept.orderBy(F.desc("momentum_score"), "area_name_en").limit(limit)


def undervalued_areas(
    df: DataFrame, period: Period, min_rows: int = 30, min_comparables: int = 3, max_discount: float = -10.0, limit: int = 10
) -> DataFrame:
    """Areas priced below areas of similar activity (within 30% of their number of sales).

    The mean over comparable areas is a range sum over the number of sales, less the area itself.
    """
    areas = (
        df.where(period.contains() & (F.col(SQM) > 0))
        .groupBy("area_name_en")
        .agg(
            rows().alias("tx_count"),
            F.avg(SQM).alias("avg_price_sqm"),
            F.countDistinct("property_type").alias("property_types"),
            share(count_where(offplan()), rows()).alias("offplan_pct"),
            share(count_where(F.col("is_luxury")), rows()).alias("luxury_pct"),
        )
        .where(F.col("tx_count") >= min_rows)
    )
    ranges = areas.withColumns(
        {"low": F.ceil(F.col("tx_count") * 0.7), "high": F.floor(F.col("tx_count") * 1.3), "one": F.lit(1)}
    )
    # The key holds many areas of equal activity, so the tree sums them before anything is joined.
    sums = range_sums(
        ranges, "tx_count", {"sqm_sum": "avg_price_sqm", "near_areas": "one"}, ranges.select("area_name_en", "low", "high"), "low", "high"
    )
    names = lowest_in_range(areas, "tx_count", "avg_price_sqm", "area_name_en", ranges.select("area_name_en", "low", "high"), "low", "high", k=5)
    shown = names.groupBy("area_name_en").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda s: s["other"]), ", ").alias("comparable_areas")
    )
    median = summarise(areas, [], [], [Quantile("m", "avg_price_sqm", 0.5)])
    others = F.col("near_areas") - 1
    found = (
        areas.join(sums.drop("low", "high"), "area_name_en")
        .where(others >= min_comparables)
        .withColumn("comparables", others)
        .withColumn("comparable_avg_price_sqm", (F.col("sqm_sum") - F.col("avg_price_sqm")) / others)
        .withColumn("price_discount", pct_change("avg_price_sqm", "comparable_avg_price_sqm"))
        .where(F.col("price_discount") < max_discount)
        .withColumn("vs_market_median", pct_change("avg_price_sqm", median.scalar()))
        .drop("sqm_sum", "near_areas")
    )
    return found.join(shown, "area_name_en").orderBy("price_discount", "area_name_en").limit(limit)


def price_arbitrage(
    df: DataFrame, period: Period, min_rows: int = 10, min_areas: int = 3, min_spread_pct: float = 20.0, limit: int = 15
) -> DataFrame:
    """The same kind of home at very different average prices across areas."""
    kinds = ["property_type", "rooms_en"]
    by_area = (
        df.where(period.contains() & F.col("property_type").isNotNull() & F.col("rooms_en").isNotNull())
        .groupBy("area_name_en", *kinds)
        .agg(rows().alias("tx_count"), F.avg(PRICE).alias("area_avg"))
        .where(F.col("tx_count") >= min_rows)
    )
    position = F.struct("area_avg", "area_name_en")
    spread = by_area.groupBy(*kinds).agg(
        rows().alias("area_count"),
        F.max("area_avg").alias("max_price"),
        F.min("area_avg").alias("min_price"),
        F.avg("area_avg").alias("overall_avg"),
        F.max_by("area_name_en", position).alias("high_price_area"),
        F.min_by("area_name_en", position).alias("low_price_area"),
    )
    kept = (
        spread.where(F.col("area_count") >= min_areas)
        .withColumns({"price_difference": F.col("max_price") - F.col("min_price"), "arbitrage_pct": pct_change("max_price", "min_price")})
        .where(F.col("arbitrage_pct") >= min_spread_pct)
    )
    return kept.orderBy(F.desc("arbitrage_pct"), *kinds).limit(limit)


def developer_shares(df: DataFrame, period: Period) -> DataFrame:
    """Market share of every developer now and in the equally long window before."""
    now, before = _current_and_before(period)
    counted = (
        df.where((now | before) & filled("developer"))
        .groupBy("developer")
        .agg(
            count_where(now).alias("current_tx"),
            count_where(before).alias("previous_tx"),
            sum_where(now, PRICE).alias("current_value"),
        )
    )
    current_total = counted.agg(F.sum("current_tx")).scalar()
    previous_total = counted.agg(F.sum("previous_tx")).scalar()
    shares = counted.withColumns({"current_total": current_total, "previous_total": previous_total}).withColumns(
        {
            "current_share": share("current_tx", "current_total"),
            "previous_share": F.coalesce(share("previous_tx", "previous_total"), F.lit(0.0)),
        }
    )
    change = F.col("current_share") - F.col("previous_share")
    return shares.drop("current_total", "previous_total").withColumn("share_change", change)


def developer_momentum(
    df: DataFrame, period: Period, min_rows: int = 20, step: float = 0.5, focus_areas: int = 5, limit: int | None = 15
) -> DataFrame:
    """Developers gaining or losing market share, biggest gain first, with the areas they sell in."""
    shares = developer_shares(df, period).where(F.col("current_tx") >= min_rows)
    trend = F.when(F.col("share_change") > step, "gaining").when(F.col("share_change") < -step, "losing").otherwise("stable")
    order = Window.partitionBy("developer").orderBy("area_name_en")
    areas = (
        df.where(period.contains() & filled("developer"))
        .select("developer", "area_name_en")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= focus_areas)
        .groupBy("developer")
        .agg(F.array_join(F.array_sort(F.collect_list("area_name_en")), ", ").alias("focus_areas"))
    )
    ranked = shares.withColumn("trend", trend)
    if limit is not None:
        ranked = ranked.orderBy(F.desc("share_change"), "developer").limit(limit)
    return ranked.join(areas, "developer", "left")


def yearly_growth(df: DataFrame, year: int, min_now: int = 500, min_before: int = 100, limit: int = 15) -> DataFrame:
    """Areas by growth of sales over the year before, among active ones."""
    now, before = F.col("transaction_year") == year, F.col("transaction_year") == year - 1
    grouped = (
        df.where(now | before)
        .groupBy("area_name_en")
        .agg(count_where(now).alias("current_tx"), count_where(before).alias("previous_tx"), avg_where(now, PRICE).alias("avg_price"))
        .where((F.col("current_tx") >= min_now) & (F.col("previous_tx") >= min_before))
        .withColumn("growth_pct", F.coalesce(pct_change("current_tx", "previous_tx"), F.lit(100.0)))
    )
    return grouped.orderBy(F.desc("growth_pct"), "area_name_en").limit(limit)


def marked_growth(base: Column | str, value: Column | str) -> Column:
    """Growth in percent to two places: a marker for growth from nothing, 0 for none from nothing."""
    base, value = (F.col(c) if isinstance(c, str) else c for c in (base, value))
    normal = F.round(pct_change(value, base), 2)
    return F.when(base > 0, normal).when(value > 0, F.lit(INFINITE_GROWTH)).otherwise(F.lit(0.0))


def marked_compound_growth(base: Column | str, value: Column | str, periods: int) -> Column:
    base, value = (F.col(c) if isinstance(c, str) else c for c in (base, value))
    rate = F.round((F.pow(F.try_divide(value.cast("double"), base.cast("double")), F.lit(1.0 / periods)) - 1) * 100, 2)
    return F.when(base > 0, rate).when(value > 0, F.lit(INFINITE_GROWTH)).otherwise(F.lit(0.0))


def growth_study(df: DataFrame, key: str, years: Sequence[int]) -> DataFrame:
    """Sales and average price per key and year side by side, with growth from year to year and overall.

    Columns are numbered by position of the year: transactions_1 is the first year.
    """
    aggregates = []
    for i, year in enumerate(years, 1):
        in_year = F.col("transaction_year") == year
        aggregates.append(count_where(in_year).alias(f"transactions_{i}"))
        aggregates.append(F.coalesce(avg_where(in_year, PRICE), F.lit(0.0)).alias(f"avg_value_{i}"))
    table = df.where(F.col("transaction_year").isin(*years)).groupBy(F.col(key).alias("name")).agg(*aggregates)
    derived = {}
    for i in range(2, len(years) + 1):
        derived[f"growth_{i}_pct"] = marked_growth(f"transactions_{i - 1}", f"transactions_{i}")
        derived[f"change_{i}"] = F.col(f"transactions_{i}") - F.col(f"transactions_{i - 1}")
    n = len(years)
    derived["compound_growth_pct"] = marked_compound_growth("transactions_1", f"transactions_{n}", n - 1)
    derived["change_total"] = F.col(f"transactions_{n}") - F.col("transactions_1")
    return table.withColumns(derived)


def with_misleading_flags(study: DataFrame, years: Sequence[int], small_base: int = 50, high_growth: float = 200.0, small_change: int = 100, low_volume: int = 10) -> DataFrame:
    """Flags growth that rests on too few sales and says why."""

    def text(c: Column) -> Column:
        return c.cast("string")

    first = F.col("transactions_1")
    reasons = [
        F.when(
            (first > 0) & (first < small_base),
            F.concat(F.lit("starts from "), text(first), F.lit(f" sales in {years[0]}")),
        )
    ]
    for i, year in enumerate(years[1:], 2):
        growth, change = F.col(f"growth_{i}_pct"), F.abs(F.col(f"change_{i}"))
        reasons.append(
            F.when(
                (F.abs(growth) > high_growth) & (change < small_change),
                F.concat(
                    F.lit(f"{year} moved by "), text(F.round(growth, 1)), F.lit("% on a difference of "), text(change), F.lit(" sales"),
                ),
            )
        )
    low = [
        F.when(
            F.col(f"transactions_{i}") < low_volume,
            F.concat(text(F.col(f"transactions_{i}")), F.lit(f" in {year}")),
        )
        for i, year in enumerate(years, 1)
    ]
    low_years = F.array_join(F.array_compact(F.array(*low)), ", ")
    reasons.append(F.when(low_years != "", F.concat(F.lit("hardly any sales: "), low_years)))
    for i, year in enumerate(years[:-1], 2):
        reasons.append(
            F.when(F.col(f"growth_{i}_pct") == INFINITE_GROWTH, F.lit(f"nothing sold in {year} to grow from"))
        )
    reason = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return study.withColumn("misleading_reason", reason).withColumn("misleading_flag", F.col("misleading_reason") != "")


def study_summary(study: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row of headline numbers of a flagged study; markers of infinite growth are left out of means."""
    growth, legit = F.col("compound_growth_pct"), ~F.col("misleading_flag")
    finite = growth != INFINITE_GROWTH
    n = len(years)
    order = F.struct("compound_growth_pct", "name")
    marked = study.withColumn("__finite", F.when(finite, growth))
    return summarise(
        marked,
        [],
        [
            rows().alias("areas_analyzed"),
            count_where(~legit).alias("areas_misleading"),
            count_where(legit).alias("areas_legitimate"),
            *[F.sum(f"transactions_{i}").alias(f"transactions_{i}") for i in range(1, n + 1)],
            pct_change(F.sum(f"transactions_{n}"), F.sum("transactions_1")).alias("market_growth_pct"),
            F.avg("__finite").alias("avg_compound_growth"),
            F.avg(F.when(legit, F.col("__finite"))).alias("avg_compound_growth_legitimate"),
            *[count_where(F.col(f"growth_{i}_pct") > 50).alias(f"growth_{i}_over_50") for i in range(2, n + 1)],
            count_where(growth < 0).alias("declining_areas"),
            F.max_by("name", order).alias("highest_growth_area"),
            F.max("compound_growth_pct").alias("highest_growth_pct"),
            F.min_by("name", order).alias("lowest_growth_area"),
            F.min("compound_growth_pct").alias("lowest_growth_pct"),
        ],
        [Quantile("median_compound_growth", "__finite", 0.5)],
    )


def study_slices(
    study: DataFrame, high_volume: int = 500, decline: float = -10.0, top: int = 50, years: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """Named extracts of a flagged study; with its years also the summary."""
    growth = F.desc("compound_growth_pct")
    summary = {} if years is None else {"summary": study_summary(study, years)}
    return summary | {
        "all": study,
        "top_legitimate": study.where(~F.col("misleading_flag")).orderBy(growth, "name").limit(top),
        "misleading": study.where("misleading_flag"),
        "high_volume": study.where(F.col("transactions_2") > high_volume),
        "declining": study.where(F.col("compound_growth_pct") < decline),
    }
