"""Supply against demand.

The shape of these tables is given by the domain; the formulas behind scores and the cut-points
between labels are this library's own, kept in one place each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import BALANCE_EDGES, BALANCE_LABELS, NO_BALANCE
from marketspark.functions.expr import (
    avg_where, band, clamp, count_where, filled, pct_change, rank_of, ratio, rows, share,
)
from marketspark.operators.metrics import PRICE, SQM, offplan, ready

# Own choice: lowest score of each class and of each timing label.
OPPORTUNITY_EDGES, OPPORTUNITY_LABELS = (30.0, 50.0, 70.0), ("Low Opportunity", "Limited Opportunity", "Moderate Opportunity", "High Opportunity")
TIMING_EDGES, TIMING_LABELS = (20.0, 40.0, 55.0, 75.0), ("Avoid", "Wait", "Monitor", "Good Entry Point", "Buy Now")
# Own choice: (completed projects, completion rate) from which a developer's record earns a label.
TRACK_RECORD = (("Highly Reliable", 8, 80.0), ("Reliable", 5, 60.0), ("Moderate", 3, 40.0), ("Unproven", 1, 0.0))
NO_TRACK_RECORD = "New Developer"
# Starting score of each track record.
RELIABILITY_BASE = {"Highly Reliable": 90.0, "Reliable": 75.0, "Moderate": 50.0, "Unproven": 25.0}
OTHER_RELIABILITY_BASE = 10.0


def market_balance(sd_ratio: Column) -> Column:
    return F.when(sd_ratio.isNull(), NO_BALANCE).otherwise(band(sd_ratio, BALANCE_EDGES, BALANCE_LABELS))


def opportunity_score(df_ratio: str = "supply_demand_ratio") -> Column:
    """50 plus price and sales growth, less the pressure of supply beyond demand; 0 to 100."""
    pressure = F.least(F.lit(40.0), (F.coalesce(F.col(df_ratio), F.lit(1.0)) - 1.0) * 10.0)
    price = F.coalesce(F.col("price_yoy_change_pct"), F.lit(0.0)) * 1.5
    sales = F.coalesce(F.col("tx_yoy_change_pct"), F.lit(0.0)) * 0.5
    return clamp(50.0 + price + sales - pressure, 0, 100)


def demand_by_area(sales: DataFrame, from_year: int, current_year: int) -> DataFrame:
    """Demand since from_year, with the change of price and sales in current_year, in one scan."""
    recent = F.col("transaction_year") >= from_year
    now, before = F.col("transaction_year") == current_year, F.col("transaction_year") == current_year - 1
    needed = sales.where(F.col("transaction_year") >= min(from_year, current_year - 1))
    return needed.groupBy(F.col("area_name_en").alias("area")).agg(
        count_where(recent).alias("demand_tx_count"),
        F.sum(F.when(recent, F.col(PRICE))).alias("demand_volume_aed"),
        avg_where(recent, PRICE).alias("demand_avg_price"),
        avg_where(recent, SQM).alias("demand_price_per_sqm"),
        count_where(recent & offplan()).alias("demand_offplan_tx"),
        count_where(recent & ready()).alias("demand_ready_tx"),
        pct_change(avg_where(now, PRICE), avg_where(before, PRICE)).alias("price_yoy_change_pct"),
        pct_change(count_where(now), count_where(before)).alias("tx_yoy_change_pct"),
    )


def supply_by_area(projects: DataFrame, years: Sequence[int]) -> DataFrame:
    is_offplan, done = F.col("is_offplan"), F.col("is_completed")
    year = F.floor(F.col("delivery_index") / F.lit(4))
    units = F.col("total_units")
    return projects.groupBy(F.col("master_development").alias("area")).agg(
        rows().alias("supply_projects"),
        count_where(is_offplan).alias("supply_offplan_projects"),
        count_where(done).alias("supply_completed_projects"),
        count_where(F.col("status_normalized") == "Under Construction").alias("supply_under_construction"),
        count_where(F.col("status_normalized") == "Launched").alias("supply_launched_projects"),
        F.sum(units).alias("supply_total_units"),
        F.sum(F.when(is_offplan, units).otherwise(0)).alias("supply_offplan_units"),
        F.sum(F.when(done, units).otherwise(0)).alias("supply_completed_units"),
        F.sum("residential_units").alias("supply_residential_units"),
        *[F.sum(F.when(is_offplan & (year == y), units).otherwise(0)).alias(f"supply_{y}") for y in years],
        F.countDistinct(F.when(is_offplan, F.col("developer"))).alias("supply_developers"),
        avg_where(is_offplan, "completion_percentage").alias("supply_avg_completion_pct"),
        F.min(F.when(is_offplan, F.col("actual_completion_date"))).alias("supply_earliest_delivery"),
        F.max(F.when(is_offplan, F.col("actual_completion_date"))).alias("supply_latest_delivery"),
    )


def supply_demand_areas(
    sales: DataFrame, projects: DataFrame, from_year: int, current_year: int, years: Sequence[int]
) -> DataFrame:
    """Supply next to demand for every area that has either.

    `years` are the delivery years shown; the first two count as near-term supply.
    """
    demand, supply = demand_by_area(sales, from_year, current_year), supply_by_area(projects, years)
    counts = [c for c in (*demand.columns, *supply.columns) if c.endswith(("_count", "_tx", "_projects", "_units", "_developers", "_construction"))]
    joined = demand.join(supply, "area", "full_outer").fillna(0, subset=[*counts, *[f"supply_{y}" for y in years]])
    sd_ratio = ratio("supply_offplan_units", "demand_offplan_tx")
    table = joined.withColumns(
        {
            "supply_demand_ratio": sd_ratio,
            "tx_per_project": ratio("demand_tx_count", "supply_projects"),
            "units_per_developer": ratio("supply_offplan_units", "supply_developers"),
            "near_term_supply": F.col(f"supply_{years[0]}") + F.col(f"supply_{years[1]}"),
        }
    )
    score, price = opportunity_score(), F.col("price_yoy_change_pct")
    sd = F.col("supply_demand_ratio")
    return table.withColumns(
        {
            "market_balance": market_balance(sd),
            "opportunity_classification": band(score, OPPORTUNITY_EDGES, OPPORTUNITY_LABELS),
            "oversupply_risk": F.when(sd > 10, "High").when(sd > 3, "Medium").when(sd.isNotNull(), "Low"),
            "price_decline_risk": F.when(price < -10, "High").when(price < 0, "Medium").when(price.isNotNull(), "Low"),
        }
    )


def developer_performance(
    sales: DataFrame, projects: DataFrame, from_year: int, segment: Column | None = None
) -> DataFrame:
    """Delivery record and sales of every developer that builds or sells."""
    is_offplan, done = F.col("is_offplan"), F.col("is_completed")
    supply = projects.where(filled("developer")).groupBy("developer").agg(
        rows().alias("supply_projects"),
        count_where(is_offplan).alias("supply_offplan_projects"),
        count_where(done).alias("supply_completed_projects"),
        F.sum(F.when(is_offplan, F.col("total_units")).otherwise(0)).alias("supply_offplan_units"),
        F.avg("completion_percentage").alias("supply_avg_completion_pct"),
        F.countDistinct("master_development").alias("supply_areas_active"),
        F.countDistinct("developer_property_type_normalized").alias("supply_product_types"),
    )
    recent = F.col("transaction_year") >= from_year
    demand = sales.where(recent & filled("developer")).groupBy("developer").agg(
        rows().alias("demand_transaction_count"),
        F.sum(PRICE).alias("demand_sales_volume"),
        F.avg(PRICE).alias("demand_avg_price"),
        count_where(offplan()).alias("demand_offplan_tx"),
    )
    joined = supply.join(demand, "developer", "full_outer")
    counts = [
        "supply_projects", "supply_offplan_projects", "supply_completed_projects", "supply_offplan_units",
        "supply_areas_active", "supply_product_types", "demand_transaction_count", "demand_offplan_tx",
    ]
    table = joined.fillna(0, subset=counts).withColumns(
        {
            "completion_rate_pct": F.coalesce(share("supply_completed_projects", "supply_projects"), F.lit(0.0)),
            "sales_velocity_pct": F.coalesce(share("demand_offplan_tx", "supply_offplan_units"), F.lit(0.0)),
            "geographic_diversification_score": F.least(F.lit(100.0), F.col("supply_areas_active") * 10.0),
            "product_diversification_score": F.least(F.lit(100.0), F.col("supply_product_types") * 20.0),
        }
    )
    record = F.when(F.lit(False), F.lit(""))
    for label, completed, rate in TRACK_RECORD:
        reached = (F.col("supply_completed_projects") >= completed) & (F.col("completion_rate_pct") >= rate)
        record = record.when(reached, label)
    table = table.withColumn("delivery_track_record", record.otherwise(NO_TRACK_RECORD))
    return table if segment is None else table.withColumn("market_segment", segment)


def market_opportunities(areas: DataFrame) -> DataFrame:
    """Opportunity score, class and timing of every area with a supply/demand ratio."""
    score = opportunity_score()
    known = areas.where(F.col("supply_demand_ratio").isNotNull()).withColumn("opportunity_score", score)
    return known.select(
        "area", "opportunity_classification", "market_balance", "opportunity_score", "supply_offplan_units",
        "demand_offplan_tx", "supply_demand_ratio", "price_yoy_change_pct", "supply_developers",
        band("opportunity_score", TIMING_EDGES, TIMING_LABELS).alias("investment_timing"),
    )


def supply_quarters(projects: DataFrame) -> DataFrame:
    """Off-plan deliveries per quarter, with the area that delivers most."""
    delivering = projects.where(F.col("is_offplan") & F.col("delivery_index").isNotNull())
    keys = ["delivery_index", "delivery_quarter"]
    # Areas first, so that the leading area of a quarter is found among area totals.
    per_area = delivering.groupBy(*keys, "master_development").agg(
        rows().alias("projects"),
        F.sum("total_units").alias("units"),
        F.sum("residential_units").alias("residential"),
        F.sum("commercial_units").alias("commercial"),
        F.sum("completion_percentage").alias("completion"),
    )
    return per_area.groupBy(*keys).agg(
        F.sum("projects").alias("projects_delivering"),
        F.sum("units").alias("total_units_delivering"),
        F.sum("residential").alias("total_residential_units"),
        F.sum("commercial").alias("total_commercial_units"),
        rows().alias("areas_delivering"),
        F.try_divide(F.sum("completion").cast("double"), F.sum("projects")).alias("avg_completion_pct"),
        F.max_by("master_development", F.struct("units", "master_development")).alias("top_area_by_units"),
    )


def supply_timeline(projects: DataFrame) -> DataFrame:
    """Off-plan deliveries per area and quarter."""
    delivering = projects.where(F.col("is_offplan") & F.col("delivery_index").isNotNull())
    return delivering.groupBy("master_development", "delivery_index", "delivery_quarter").agg(
        rows().alias("projects_delivering"),
        F.sum("total_units").alias("units_delivering"),
        F.countDistinct("developer").alias("active_developers"),
    )


def parse_quarter(label: str) -> int:
    """Running number of a quarter label such as "Q1 2026"."""
    return int(label[3:]) * 4 + int(label[1]) - 1


def delivery_waves(quarters: DataFrame, start_quarter: str, ahead: int = 8) -> DataFrame:
    """The next quarters with their intensity relative to the mean of all quarters from the start on."""
    kept = quarters.where(F.col("delivery_index") >= parse_quarter(start_quarter))
    mean = kept.agg(F.avg("total_units_delivering")).scalar()
    intensity = F.round(ratio(F.col("total_units_delivering") * 100.0, mean), 1)
    return kept.withColumn("wave_intensity_pct", intensity).orderBy("delivery_index").limit(ahead)


def supply_saturation(areas: DataFrame, threshold: float = 3.0, min_units: int = 500) -> DataFrame:
    sd, price = F.col("supply_demand_ratio"), F.col("price_yoy_change_pct")
    severity = (
        F.when((sd > 10) & (price < -10), "CRITICAL").when((sd > 5) & (price < -5), "HIGH").when(sd > threshold, "MODERATE").otherwise("LOW")
    )
    kept = areas.where((sd > threshold) & (F.col("supply_offplan_units") >= min_units))
    return kept.select(
        "area", "market_balance", "supply_offplan_units", "demand_offplan_tx", "supply_demand_ratio", "oversupply_risk",
        "price_yoy_change_pct", "tx_yoy_change_pct", "supply_developers", "near_term_supply", severity.alias("saturation_severity"),
    )


def supply_hotspots(
    areas: DataFrame, min_projects: int = 5, min_tx_growth: float = 20.0, max_ratio: float = 3.0, min_developers: int = 3
) -> DataFrame:
    sd = F.col("supply_demand_ratio")
    score = (
        F.col("tx_yoy_change_pct") * 0.4 + F.col("price_yoy_change_pct") * 0.3 + F.col("supply_developers") * 2
        + F.when(sd < 1.0, 20).otherwise(0)
    )
    kept = areas.where(
        (F.col("supply_offplan_projects") >= min_projects)
        & (F.col("tx_yoy_change_pct") > min_tx_growth)
        & ((sd < max_ratio) | sd.isNull())
        & (F.col("supply_developers") >= min_developers)
    )
    return kept.select(
        "area", "opportunity_classification", "market_balance", "supply_offplan_projects", "supply_offplan_units",
        "demand_offplan_tx", "supply_demand_ratio", "price_yoy_change_pct", "tx_yoy_change_pct", "supply_developers",
        "near_term_supply", score.alias("momentum_score"),
    )


def developer_reliability(performance: DataFrame, min_completed: int = 2, developer: str | None = None) -> DataFrame:
    base = F.lit(OTHER_RELIABILITY_BASE)
    for label, value in RELIABILITY_BASE.items():
        base = F.when(F.col("delivery_track_record") == label, F.lit(value)).otherwise(base)
    score = (
        base + F.col("completion_rate_pct") * 0.1 + F.col("geographic_diversification_score") * 0.5
        - F.when(F.col("sales_velocity_pct") < 5, 10.0).otherwise(0.0)
    )
    kept = performance.where(F.col("supply_completed_projects") >= min_completed)
    if developer is not None:
        kept = kept.where(F.col("developer") == developer)
    return kept.withColumn("reliability_score", clamp(score, 0, 100))


def arbitrage_opportunities(
    areas: DataFrame, min_price_growth: float = 10.0, max_ratio: float = 2.0, max_developers: int = 10, min_offplan_tx: int = 10
) -> DataFrame:
    sd = F.col("supply_demand_ratio")
    score = (
        F.col("price_yoy_change_pct") * 1.5 + (2.0 - F.coalesce(sd, F.lit(2.0))) * 20 + (10 - F.col("supply_developers")) * 3
        + F.when(F.col("near_term_supply") < 1000, 15).otherwise(0)
    )
    kept = areas.where(
        (F.col("price_yoy_change_pct") > min_price_growth)
        & ((sd < max_ratio) | sd.isNull())
        & (F.col("supply_developers") <= max_developers)
        & (F.col("demand_offplan_tx") > min_offplan_tx)
    )
    return kept.select(
        "area", "opportunity_classification", "market_balance", "supply_offplan_units", "demand_offplan_tx", "supply_demand_ratio",
        "price_yoy_change_pct", "demand_avg_price", "demand_price_per_sqm", "supply_developers", "near_term_supply",
        clamp(score, 0, 100).alias("arbitrage_score"),
    )


def area_top_developers(projects: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("area").orderBy(F.desc("units"), "developer")
    grouped = projects.where(F.col("is_offplan") & filled("developer")).groupBy(F.col("master_development").alias("area"), "developer").agg(
        rows().alias("projects"), F.sum("total_units").alias("units"), F.avg("completion_percentage").alias("avg_completion")
    )
    return grouped.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def area_dossiers(
    areas: DataFrame, timeline: DataFrame, projects: DataFrame, start_quarter: str, quarters: int = 8, developers: int = 5
) -> DataFrame:
    """Everything about supply and demand of each area in one row.

    The nested lists hold at most `quarters` and `developers` entries, cut before they are collected.
    """
    order = Window.partitionBy("master_development").orderBy("delivery_index")
    coming = (
        timeline.where(F.col("delivery_index") >= parse_quarter(start_quarter))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= quarters)
        .groupBy(F.col("master_development").alias("area"))
        .agg(F.array_sort(F.collect_list(F.struct("delivery_index", "delivery_quarter", "projects_delivering", "units_delivering", "active_developers"))).alias("delivery_timeline"))
    )
    leading = (
        area_top_developers(projects, developers)
        .groupBy("area")
        .agg(F.array_sort(F.collect_list(F.struct("place", "developer", "projects", "units", "avg_completion"))).alias("top_developers"))
    )
    scores = market_opportunities(areas).select("area", "opportunity_score", "investment_timing")
    return areas.join(coming, "area", "left").join(leading, "area", "left").join(scores, "area", "left")


def project_profiles(dossiers: DataFrame) -> DataFrame:
    """Context for articles about projects: market, pipeline, leading developers and outlook of the area."""
    score = F.col("opportunity_score")
    potential = F.when(score > 70, "High").when(score > 40, "Moderate").otherwise("Standard")
    return dossiers.select(
        "area", "market_balance", "supply_demand_ratio", "demand_avg_price", "price_yoy_change_pct", "supply_offplan_units",
        "supply_offplan_projects", "supply_developers", "near_term_supply", "opportunity_classification", "opportunity_score",
        "investment_timing", potential.alias("potential"), F.slice("top_developers", 1, 3).alias("leading_developers"),
    )


def market_alerts(
    areas: DataFrame, opportunities: DataFrame, saturation: float = 3.0, decline: float = -10.0, min_units: int = 500, min_offplan_tx: int = 20
) -> DataFrame:
    """Oversupply (ten at most), opportunity and price-decline alerts (five each) with severity and text."""
    sd, price, score = F.col("supply_demand_ratio"), F.col("price_yoy_change_pct"), F.col("opportunity_score")
    units, tx = F.col("supply_offplan_units").cast("string"), F.col("demand_offplan_tx").cast("string")

    def shown(c: Column, places: int) -> Column:
        return F.round(c, places).cast(f"decimal(18,{places})").cast("string")

    def alert(kind: str, severity: Column, message: Column) -> list[Column]:
        return ["area", F.lit(kind).alias("alert_type"), severity.alias("severity"), message.alias("message")]

    over = (
        areas.where((sd > saturation) & (F.col("supply_offplan_units") > min_units))
        .orderBy(F.desc("supply_demand_ratio"), "area").limit(10)
        .select(*alert("OVERSUPPLY", F.when(sd > 10, "HIGH").otherwise("MODERATE"),
                       F.concat(units, F.lit(" off-plan units meet "), tx, F.lit(" off-plan sales, "), shown(sd, 1), F.lit(" units a sale"))))
    )
    good = (
        opportunities.where(F.col("opportunity_classification").isin("High Opportunity", "Moderate Opportunity"))
        .orderBy(F.desc("opportunity_score"), "area").limit(5)
        .select(*alert("OPPORTUNITY", F.when(score > 80, "HIGH").otherwise("MODERATE"),
                       F.concat(F.lit("scores "), shown(score, 0), F.lit(" with "), tx, F.lit(" off-plan sales of "), units, F.lit(" off-plan units"))))
    )
    falling = (
        areas.where((price < decline) & (F.col("demand_offplan_tx") > min_offplan_tx))
        .orderBy("price_yoy_change_pct", "area").limit(5)
        .select(*alert("RISK", F.lit("HIGH"),
                       F.concat(F.lit("mean price moved by "), shown(price, 1), F.lit("% in a year, "), units, F.lit(" units still to come"))))
    )
    return over.unionByName(good).unionByName(falling)


def balance_distribution(areas: DataFrame) -> DataFrame:
    """Areas, off-plan units and mean ratio per balance label, from undersupplied to oversupplied."""
    known = areas.where(F.col("market_balance") != NO_BALANCE)
    return known.groupBy("market_balance").agg(
        rows().alias("areas"), F.sum("supply_offplan_units").alias("total_offplan_units"), F.avg("supply_demand_ratio").alias("avg_sd_ratio")
    ).withColumn("balance_order", rank_of("market_balance", BALANCE_LABELS).cast("int"))


def supply_totals(areas: DataFrame) -> DataFrame:
    balance = F.col("market_balance")
    return areas.agg(
        rows().alias("total_areas"),
        F.sum("supply_offplan_units").alias("total_offplan_units"),
        F.sum("demand_offplan_tx").alias("total_offplan_transactions"),
        F.avg("supply_demand_ratio").alias("avg_supply_demand_ratio"),
        count_where(balance.isin("Oversupplied", "Severely Oversupplied")).alias("oversupplied_areas"),
        count_where(balance.isin("Undersupplied", "Severely Undersupplied")).alias("undersupplied_areas"),
    )


def areas_in_balance(areas: DataFrame, opportunities: DataFrame, balance: str) -> DataFrame:
    """Areas of one balance label, best opportunity first, then lowest ratio."""
    scores = opportunities.select("area", "opportunity_score", "investment_timing")
    kept = areas.where(F.col("market_balance") == balance).join(scores, "area", "left")
    return kept.select(
        "area", "supply_demand_ratio", "supply_offplan_units", "demand_offplan_tx", "market_balance", "opportunity_score",
        "investment_timing", "opportunity_classification", "price_yoy_change_pct", "supply_developers",
    ).orderBy(F.desc(F.coalesce("opportunity_score", F.lit(0.0))), "supply_demand_ratio", "area")


def opportunity_ranking(opportunities: DataFrame, limit: int = 20) -> DataFrame:
    return opportunities.orderBy(F.desc("opportunity_score"), "area").limit(limit)


def opportunity_by_balance(areas: DataFrame, opportunities: DataFrame) -> DataFrame:
    scores = opportunities.select("area", "opportunity_score")
    known = areas.where(F.col("market_balance") != NO_BALANCE).join(scores, "area", "left")
    return known.groupBy("market_balance").agg(
        rows().alias("area_count"), F.avg("opportunity_score").alias("avg_opportunity"), F.max("price_yoy_change_pct").alias("max_price_growth")
    )
