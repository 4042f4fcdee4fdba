"""Fixed combinations of jobs: metric rebuilds, report intelligence and chart data.

A bundle returns named DataFrames. Nothing runs until one is used, but for numbered members, which are written when
they are built; pass sales through lineage.shared to compute them once for the whole bundle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from marketspark.config import MarketConfig
from marketspark.functions.lineage import shared
from marketspark.functions.periods import Period
from marketspark.functions.scale import join_on, name_parts, name_rows
from marketspark.operators import anomalies, charts, metrics, opportunities, profiles, supply, trends
from marketspark.sources.sinks import replace_table


def metric_tables(sales: DataFrame) -> dict[str, DataFrame]:
    """Every metric table of the verified sales."""
    monthly = metrics.monthly_trends(sales)
    return {
        "metrics_area": metrics.area_metrics(sales),
        "metrics_area_developers": name_rows(sales, ["area_name_en"], "developer"),
        "metrics_monthly_trends": monthly,
        "metrics_monthly_trend_ids": metrics.monthly_members(sales, monthly),
        "metrics_price_changes": metrics.month_over_month(monthly),
        "metrics_yoy_comparison": metrics.year_over_year(monthly),
        "metrics_property_types": metrics.property_type_metrics(sales),
        "metrics_luxury": metrics.luxury_monthly(sales),
        "metrics_luxury_summary": metrics.luxury_summary(sales),
        "metrics_projects": metrics.project_metrics(sales),
        "metrics_developers": metrics.developer_metrics(sales),
        "metrics_offplan": metrics.offplan_monthly(sales),
        "metrics_offplan_comparison": metrics.offplan_comparison(sales),
    }


# Lists of names in metric tables: table with all their parts, keys, column, name; and the sales they are of.
NAME_LISTS = (
    ("metrics_area_developer_lists", ("area_name_en",), "developer", "top_developers", None),
    ("metrics_area_metro_lists", ("area_name_en",), "nearest_metro_en", "nearby_metros", None),
    ("metrics_area_mall_lists", ("area_name_en",), "nearest_mall_en", "nearby_malls", None),
    ("metrics_luxury_project_lists", ("area_name_en", "transaction_year", "transaction_month"), "project_name_en", "luxury_projects", "is_luxury"),
    ("metrics_luxury_developer_lists", ("area_name_en", "transaction_year", "transaction_month"), "developer", "luxury_developers", "is_luxury"),
    ("metrics_luxury_year_project_lists", ("area_name_en", "transaction_year"), "project_name_en", "luxury_projects", "is_luxury"),
    ("metrics_project_unit_type_lists", ("project_name_en", "developer", "area_name_en", "transaction_type"), "rooms_en", "unit_types_available", "project_name_en <> ''"),
)


def name_tables(sales: DataFrame) -> dict[str, DataFrame]:
    """The whole lists behind the name columns of the metric tables, in numbered parts, of the columns the sales have."""
    return {
        table: name_parts(sales.where(only) if only else sales, keys, column, name)
        for table, keys, column, name, only in NAME_LISTS
        if column in sales.columns
    }


def rebuild_all(sales: DataFrame, folder: str) -> list[str]:
    """Computes the verified sales once and replaces every metric table and name list below a folder."""
    sales = shared(sales)
    tables = metric_tables(sales) | name_tables(sales)
    for name, table in tables.items():
        replace_table(table, f"{folder}/{name}")
    return list(tables)


def rebuild_supply(
    sales: DataFrame, projects: DataFrame, folder: str, from_year: int, current_year: int, years: Sequence[int]
) -> list[str]:
    """Replaces the supply and demand tables below a folder."""
    sales, projects = shared(sales), shared(projects)
    areas = shared(supply.supply_demand_areas(sales, projects, from_year, current_year, years))
    tables = {
        "metrics_supply_demand_area": areas,
        "metrics_developer_performance": supply.developer_performance(sales, projects, from_year),
        "metrics_market_opportunities": supply.market_opportunities(areas),
        "metrics_supply_quarterly": supply.supply_quarters(projects),
        "metrics_supply_timeline": supply.supply_timeline(projects),
    }
    for name, table in tables.items():
        replace_table(table, f"{folder}/{name}")
    return list(tables)


def trend_parts(sales: DataFrame, keys: Sequence[str], as_of: date, season_start: date) -> dict[str, DataFrame]:
    return {
        "price_momentum": trends.price_momentum(sales, keys, as_of),
        "volume_momentum": trends.volume_momentum(sales, keys, as_of),
        "seasonality": trends.seasonality(sales, keys, season_start, as_of),
        "market_cycle": trends.market_cycle(sales, keys, as_of),
    }


def market_report(
    sales: DataFrame, period: Period, season_start: date, config: MarketConfig = MarketConfig(), lookback_months: int = 12,
    max_discount: float = -10.0,
) -> dict[str, DataFrame]:
    """Anomalies, opportunities, market-wide trends and concentration for a market report."""
    last_day = date.fromordinal(period.end.toordinal() - 1)
    return {
        "record_transactions": anomalies.record_sales(sales, period),
        "ultra_luxury_records": anomalies.ultra_luxury_records(sales, period, config.ultra_luxury_price),
        "volume_spikes": anomalies.volume_spikes(sales, period, lookback_months),
        "volume_drops": anomalies.volume_drops(sales, period, lookback_months),
        "new_developers": anomalies.new_developers(sales, period, lookback_months),
        "developer_surges": anomalies.developer_surges(sales, period, lookback_months),
        "emerging_hotspots": opportunities.emerging_hotspots(sales, period),
        "undervalued_areas": opportunities.undervalued_areas(sales, period, max_discount=max_discount),
        "price_arbitrage": opportunities.price_arbitrage(sales, period),
        "developer_momentum": opportunities.developer_momentum(sales, period),
        **trend_parts(sales, [], last_day, season_start),
        "market_concentration": profiles.market_concentration(sales.where(period.contains())),
        "segment_distribution": profiles.segment_distribution(sales.where(period.contains()), config.segment_edges),
    }


def area_guides(
    sales: DataFrame, as_of: date, season_start: date, edges: Sequence[float], dossiers: DataFrame | None = None
) -> DataFrame:
    """Profile, trends and, where supply is known, the supply side of every area in one row each."""
    guide = profiles.area_profiles(sales, edges)
    guide = join_on(guide, trends.combined_trends(sales, ["area_name_en"], as_of, season_start), ["area_name_en"])
    names = profiles.comparable_areas(sales).groupBy("area_name_en").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nearness", "comparable"))), lambda s: s["comparable"]).alias("comparable_areas")
    )
    guide = join_on(guide, names, ["area_name_en"])
    if dossiers is None:
        return guide
    return join_on(guide, dossiers.withColumnRenamed("area", "area_name_en"), ["area_name_en"])


def developer_intelligence(sales: DataFrame, period: Period, edges: Sequence[float], min_rows: int = 20, step: float = 0.5) -> DataFrame:
    """Profile of every developer next to its gain or loss of market share."""
    momentum = opportunities.developer_momentum(sales, period, min_rows, step, limit=None)
    shown = momentum.select("developer", "current_share", "previous_share", "share_change", "trend", "focus_areas")
    return profiles.developer_profiles(sales, edges).join(shown, "developer", "left")


def luxury_intelligence(sales: DataFrame, period: Period, config: MarketConfig = MarketConfig()) -> dict[str, DataFrame]:
    segments = profiles.segment_distribution(sales.where(period.contains()), config.segment_edges)
    return {
        "record_transactions": anomalies.record_sales(sales, period, 10),
        "ultra_luxury_records": anomalies.ultra_luxury_records(sales, period, config.ultra_luxury_price),
        "luxury_share": segments.where(F.col("segment").isin("luxury", "ultra_luxury")),
    }


def offplan_intelligence(sales: DataFrame, period: Period, lookback_months: int = 12, offplan_only: bool = False) -> dict[str, DataFrame]:
    if offplan_only:
        sales = sales.where(metrics.offplan())
    return {
        "new_developers": anomalies.new_developers(sales, period, lookback_months),
        "developer_surges": anomalies.developer_surges(sales, period, lookback_months),
        "volume_spikes": anomalies.volume_spikes(sales, period, lookback_months),
        "emerging_hotspots": opportunities.emerging_hotspots(sales, period),
    }


def supply_forecast(
    areas: DataFrame, quarters: DataFrame, start_quarter: str, ahead: int = 8, hotspot_limits: dict[str, float] | None = None, **alert_limits: float
) -> dict[str, DataFrame]:
    saturation = supply.supply_saturation(areas).orderBy(F.desc("supply_demand_ratio"), "area").limit(10)
    return {
        "delivery_waves": supply.delivery_waves(quarters, start_quarter, ahead),
        "saturation": saturation,
        "hotspots": supply.supply_hotspots(areas, **(hotspot_limits or {})),
        "alerts": supply.market_alerts(areas, supply.market_opportunities(areas), **alert_limits),
    }


# Fields of each finding that its serialised form keeps.
SERIALISED = {
    "record_transactions": ("area_name_en", "actual_worth", "property_type", "rank"),
    "volume_spikes": ("area_name_en", "change_pct", "current_count"),
    "new_developers": ("developer", "transaction_count", "total_value"),
    "emerging_hotspots": ("area_name_en", "tx_growth", "price_growth"),
    "undervalued_areas": ("area_name_en", "price_discount", "avg_price_sqm"),
    "developer_momentum": ("developer", "share_change", "trend"),
    "price_momentum": ("momentum_3m", "momentum_6m", "momentum_12m", "trajectory"),
    "market_cycle": ("phase", "phase_confidence"),
}


def serialised(bundle: dict[str, DataFrame], places: int = 4) -> DataFrame:
    """Findings of a bundle as one table of (finding, JSON object).

    Broken numbers have a fixed number of places, so that every engine and every size of a number gives the same text; a
    field without a value is left out.
    """
    out = None
    for name, fields in SERIALISED.items():
        if name in bundle:
            kinds = dict(bundle[name].dtypes)
            shown = [F.col(f).cast(f"decimal({20 + places},{places})").alias(f) if kinds[f] in ("double", "float") else F.col(f) for f in fields]
            part = bundle[name].select(F.lit(name).alias("finding"), F.to_json(F.struct(*shown)).alias("value"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the bundle holds no finding with a serialised form")
    return out


def chart_data(sales: DataFrame, report: str, year: int, quarter: int | None = None, tier_edges: Sequence[float] = MarketConfig().band_edges) -> dict[str, DataFrame]:
    """The chart series of one kind of report: market, luxury, offplan, area_guide or developer."""
    chosen = charts.in_period(sales, year, quarter)

    def names(name: str, segment: str | None = None) -> DataFrame:
        return charts.top_names(sales, name, year=year, quarter=quarter, segment=segment)

    sale_types = charts.segment_mix(chosen, F.col("transaction_type"))
    bundles = {
        "market": {
            "monthly_trend": charts.monthly_trend(sales, year),
            "market_segments": sale_types,
            "top_areas": names("area_name_en"),
        },
        "luxury": {
            "luxury_trend": charts.monthly_trend(sales, year, "luxury"),
            "luxury_tiers": charts.segment_mix(chosen, charts.price_tier(tier_edges)),
            "top_luxury_areas": names("area_name_en", "luxury"),
        },
        "offplan": {
            "offplan_trend": charts.monthly_trend(sales, year, "offplan"),
            "offplan_vs_ready": sale_types,
            "developer_pipeline": names("developer", "offplan"),
        },
        "area_guide": {
            "price_trend": charts.monthly_trend(sales, year),
            "property_types": charts.segment_mix(chosen, F.col("property_type")),
            "developer_share": names("developer"),
        },
        "developer": {
            "transaction_volume": charts.monthly_trend(sales, year),
            "project_areas": names("area_name_en"),
        },
    }
    if report not in bundles:
        raise ValueError(f"unknown report: {report}")
    return bundles[report]
