"""Registered queries: supply list and supply against demand."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketspark.catalog.registry import TX, register
from marketspark.operators import supply, supply_ingest
from marketspark.sources import driver_tables as tables

AS_OF = date(2001, 6, 30)
YEARS = (2001, 2002, 2003)

# Raw projects, then every column of the enriched list.
RAW = """
WITH units AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS INTEGER) AS total_units, CAST(sum(l_quantity) FILTER (p_type IN ('STANDARD', 'ECONOMY')) AS INTEGER) AS apartments,
    CAST(sum(l_quantity) FILTER (p_type = 'MEDIUM') AS INTEGER) AS villas, CAST(sum(l_quantity) FILTER (p_type = 'SMALL') AS INTEGER) AS townhouses,
    CAST(sum(l_quantity) FILTER (p_type = 'LARGE') AS INTEGER) AS offices
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS project_id, o_orderkey AS k, 'Project ' || o_orderkey AS project_name, n_name AS master_development, c_mktsegment AS seg,
    CASE WHEN o_custkey % 50 <> 0 THEN replace(c_name, 'Customer', 'Supplier') END AS developer,
    o_orderkey % 1000 < n_nationkey * n_nationkey AS still_open, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS ordered,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH AS DATE) AS planned,
    coalesce(total_units, 0) AS total_units, coalesce(apartments, 0) AS total_apartments, coalesce(villas, 0) AS total_villas,
    coalesce(townhouses, 0) AS total_townhouses, coalesce(offices, 0) AS total_offices
  FROM orders LEFT JOIN units ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sup0 AS (
  SELECT *, CASE WHEN k % 7 <> 0 THEN planned END AS actual_completion_date, CASE WHEN k % 9 <> 0 THEN ordered END AS given_launch,
    CASE seg WHEN 'BUILDING' THEN 'Apartment' WHEN 'HOUSEHOLD' THEN 'Villa' WHEN 'MACHINERY' THEN 'Commercial' WHEN 'FURNITURE' THEN 'Mixed Use' ELSE 'Other' END AS property_type,
    CASE WHEN NOT still_open THEN 'Completed' WHEN s = 'O' THEN 'Under Construction' WHEN s = 'P' THEN 'On Hold' ELSE 'Launched' END AS status_normalized,
    CASE WHEN seg <> 'HOUSEHOLD' THEN 'Mid-Rise' END AS height_class,
    CASE WHEN NOT still_open THEN 100 WHEN s = 'O' THEN 50 ELSE 0 END AS completion_percentage,
    'Q' || quarter(planned) || ' ' || year(planned) AS delivery_quarter, CAST(year(planned) * 4 + quarter(planned) - 1 AS INTEGER) AS delivery_index,
    master_development || ' > ' || seg AS location_full, total_apartments + total_townhouses + total_villas AS residential_units, total_offices AS commercial_units,
    total_units - total_apartments - total_townhouses - total_villas - total_offices AS unit_mismatch_diff FROM raw),
sup AS (
  SELECT *, coalesce(given_launch, CAST(actual_completion_date - INTERVAL 24 MONTH AS DATE)) AS launch_date, given_launch IS NULL AS has_missing_launch_date,
    given_launch IS NULL AND actual_completion_date IS NOT NULL AS launch_date_is_estimated, unit_mismatch_diff <> 0 AS has_unit_mismatch, total_units = 0 AS has_zero_units,
    developer IS NULL AS has_missing_developer, k % 11 = 0 AS has_missing_location, residential_units > 0 AS is_residential,
    status_normalized IN ('Launched', 'Under Construction') AS is_offplan, residential_units > 0 AND commercial_units > 0 AS is_mixed_use, status_normalized = 'Completed' AS is_completed,
    CASE WHEN k % 11 = 0 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN developer IS NULL THEN 0.85::DOUBLE ELSE 1 END
      * CASE WHEN given_launch IS NULL AND actual_completion_date IS NULL THEN 0.9::DOUBLE ELSE 1 END
      * CASE WHEN unit_mismatch_diff <> 0 AND total_units >= 10 THEN 0.8::DOUBLE ELSE 1 END AS quality_score,
    total_units <> 0 AND NOT (unit_mismatch_diff <> 0 AND total_units < 10) AS is_valid FROM sup0),
sp AS (SELECT * FROM sup WHERE is_valid)
"""


def _enriched(spark, sf):
    return supply_ingest.enrich(tables.supply_raw(spark, sf))


def _projects(spark, sf):
    return supply_ingest.clean_projects(_enriched(spark, sf))


def _text(df, *names):
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def _enriched_query(name, *columns, dates=(), sql_names=None):
    shown = ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" if c in dates else f"{(sql_names or {}).get(c, c)} AS {c}" for c in ("project_id", *columns)
    )
    kwargs = {"r6": "quality_score"} if "quality_score" in columns else {}

    @register(name, RAW + f"SELECT {shown} FROM sup", **kwargs)
    def build(spark, sf):
        return _text(_enriched(spark, sf).select("project_id", *columns), *dates)

    return build


_enriched_query("s3_supply_scan", "project_name", "master_development", "total_units")
_enriched_query("e17_supply_dates", "actual_completion_date", dates=("actual_completion_date",))
_enriched_query("e18_supply_property_type", "developer_property_type_normalized", sql_names={"developer_property_type_normalized": "property_type"})
_enriched_query("e19_supply_status", "status_normalized")
_enriched_query("e20_supply_developer", "developer")
_enriched_query("e21_supply_height_class", "height_class")
_enriched_query("e22_supply_delivery_quarter", "delivery_quarter", "delivery_index")
_enriched_query("e23_supply_location_path", "location_full")
_enriched_query("e24_supply_unit_sums", "residential_units", "commercial_units")
_enriched_query("e25_supply_unit_mismatch", "unit_mismatch_diff", "has_unit_mismatch")
_enriched_query("e26_supply_quality_flags", "has_zero_units", "has_missing_developer", "has_missing_launch_date", "has_missing_location")
_enriched_query("e27_supply_launch_estimate", "launch_date", "launch_date_is_estimated", dates=("launch_date",))
_enriched_query("e28_supply_use_flags", "is_residential", "is_offplan", "is_mixed_use", "is_completed")
_enriched_query("e29_supply_quality_score", "quality_score", "is_valid")


PROFILE = {
    "valid": "is_valid", "offplan": "is_offplan", "completed": "is_completed", "unit_mismatch": "has_unit_mismatch", "zero_units": "has_zero_units",
    "missing_developer": "has_missing_developer", "missing_launch_date": "has_missing_launch_date", "score_from_0_9": "quality_score >= 0.9",
    "score_from_0_7": "quality_score >= 0.7", "score_below_0_7": "quality_score < 0.7",
}


@register("e30_supply_load_profile", RAW + " UNION ALL ".join(
    f"SELECT '{n}' AS measure, count(*) FILTER ({c}) AS projects, count(*) FILTER ({c}) * 100.0::DOUBLE / count(*) AS pct FROM sup" for n, c in PROFILE.items()), r6="pct")
def e30(spark, sf):
    return supply_ingest.load_profile(_enriched(spark, sf))


@register("e30_supply_top_values", RAW + " UNION ALL ".join(
    f"""SELECT '{s}' AS section, {c} AS name, count(*) AS projects, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM sup WHERE {w} GROUP BY 2 QUALIFY rank <= 10"""
    for s, c, w in (("property_type", "property_type", "true"), ("area", "master_development", "is_valid"), ("developer", "developer", "is_valid AND developer IS NOT NULL"))))
def e30b(spark, sf):
    return supply_ingest.top_values(_enriched(spark, sf))


RULES = {
    "project id missing": "project_id IS NULL", "project name missing": "project_name IS NULL", "status missing": "status_normalized IS NULL",
    "total units missing": "project_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)", "units differ from sum by more than 5": "abs(unit_mismatch_diff) > 5",
    "completed below 100 percent": "is_completed AND completion_percentage < 100",
    "completed in the future": "is_completed AND actual_completion_date > DATE '2001-06-30'", "launched after completion": "launch_date > actual_completion_date",
    "completion percentage out of range": "completion_percentage NOT BETWEEN 0 AND 100", "negative units": "total_units < 0",
    "completion year out of range": "year(planned) NOT BETWEEN 1998 AND 2002",
}


@register("e31_supply_rule_audit", RAW + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS failures FROM sup" for n, c in RULES.items()))
def e31(spark, sf):
    return supply_ingest.rule_audit(_enriched(spark, sf), AS_OF, (1998, 2002))


@register("e32_supply_classes", RAW + """SELECT project_id,
  CASE WHEN total_units = 0 THEN 'Unknown' WHEN total_units < 50 THEN 'Small' WHEN total_units < 200 THEN 'Medium' WHEN total_units < 500 THEN 'Large' ELSE 'Mega' END AS size_class,
  CASE WHEN total_apartments > 0 AND total_villas = 0 THEN 'Apartments Only' WHEN total_villas > 0 AND total_apartments = 0 THEN 'Villas Only'
    WHEN total_townhouses > 0 THEN 'Includes Townhouses' WHEN total_offices > 0 THEN 'Commercial/Mixed' ELSE 'Other' END AS unit_mix_class FROM sup""")
def e32(spark, sf):
    df = _enriched(spark, sf)
    return df.select("project_id", supply_ingest.size_class().alias("size_class"), supply_ingest.unit_mix_class().alias("unit_mix_class"))


@register("e33_strictly_offplan", RAW + """SELECT project_id FROM sup WHERE is_offplan AND completion_percentage < 100
  AND (actual_completion_date IS NULL OR actual_completion_date > DATE '2001-06-30')""")
def e33(spark, sf):
    return _enriched(spark, sf).where(supply_ingest.strictly_offplan(AS_OF)).select("project_id")


def _band(value, edges, labels):
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


SCORE = """greatest(0.0, least(100.0, 50.0 + coalesce(price_yoy_change_pct, 0) * 1.5 + coalesce(tx_yoy_change_pct, 0) * 0.5
  - least(40.0, (coalesce(supply_demand_ratio, 1.0) - 1.0) * 10.0)))"""
# An area without sales or without projects has none of them, not an unknown number.
COUNTS = (
    "demand_tx_count", "demand_offplan_tx", "demand_ready_tx", "supply_projects", "supply_offplan_projects", "supply_completed_projects",
    "supply_under_construction", "supply_launched_projects", "supply_total_units", "supply_offplan_units", "supply_completed_units",
    "supply_residential_units", "supply_developers", *[f"supply_{y}" for y in YEARS],
)
AREAS = TX + "," + RAW.strip().removeprefix("WITH") + f""", dem AS (
  SELECT area_name_en AS area, count(*) FILTER (transaction_year >= 1999) AS demand_tx_count, sum(actual_worth) FILTER (transaction_year >= 1999) AS demand_volume_aed,
    avg(actual_worth) FILTER (transaction_year >= 1999) AS demand_avg_price, avg(meter_sale_price) FILTER (transaction_year >= 1999) AS demand_price_per_sqm,
    count(*) FILTER (transaction_year >= 1999 AND transaction_type = 'Off-Plan') AS demand_offplan_tx, count(*) FILTER (transaction_year >= 1999 AND transaction_type = 'Existing') AS demand_ready_tx,
    (avg(actual_worth) FILTER (transaction_year = 2000) - avg(actual_worth) FILTER (transaction_year = 1999)) / avg(actual_worth) FILTER (transaction_year = 1999) * 100 AS price_yoy_change_pct,
    (count(*) FILTER (transaction_year = 2000) - count(*) FILTER (transaction_year = 1999))::DOUBLE / count(*) FILTER (transaction_year = 1999) * 100 AS tx_yoy_change_pct
  FROM tx WHERE transaction_year >= 1999 GROUP BY 1),
sar AS (
  SELECT master_development AS area, count(*) AS supply_projects, count(*) FILTER (is_offplan) AS supply_offplan_projects, count(*) FILTER (is_completed) AS supply_completed_projects,
    count(*) FILTER (status_normalized = 'Under Construction') AS supply_under_construction, count(*) FILTER (status_normalized = 'Launched') AS supply_launched_projects,
    CAST(sum(total_units) AS BIGINT) AS supply_total_units, CAST(coalesce(sum(total_units) FILTER (is_offplan), 0) AS BIGINT) AS supply_offplan_units,
    CAST(coalesce(sum(total_units) FILTER (is_completed), 0) AS BIGINT) AS supply_completed_units, CAST(sum(residential_units) AS BIGINT) AS supply_residential_units,
    {", ".join(f"CAST(coalesce(sum(total_units) FILTER (is_offplan AND delivery_index // 4 = {y}), 0) AS BIGINT) AS supply_{y}" for y in YEARS)},
    count(DISTINCT developer) FILTER (is_offplan) AS supply_developers, avg(completion_percentage) FILTER (is_offplan) AS supply_avg_completion_pct,
    min(actual_completion_date) FILTER (is_offplan) AS supply_earliest_delivery, max(actual_completion_date) FILTER (is_offplan) AS supply_latest_delivery
  FROM sp GROUP BY 1),
sdj AS (SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}) FROM dem FULL JOIN sar USING (area)),
sd0 AS (SELECT *, supply_offplan_units::DOUBLE / nullif(demand_offplan_tx, 0) AS supply_demand_ratio, demand_tx_count::DOUBLE / nullif(supply_projects, 0) AS tx_per_project,
  supply_offplan_units::DOUBLE / nullif(supply_developers, 0) AS units_per_developer, supply_2001 + supply_2002 AS near_term_supply FROM sdj),
sd AS (SELECT *, CASE WHEN supply_demand_ratio IS NULL THEN 'Insufficient Data' ELSE {_band("supply_demand_ratio", supply.BALANCE_EDGES, supply.BALANCE_LABELS)} END AS market_balance,
  {_band(SCORE, supply.OPPORTUNITY_EDGES, supply.OPPORTUNITY_LABELS)} AS opportunity_classification,
  CASE WHEN supply_demand_ratio > 10 THEN 'High' WHEN supply_demand_ratio > 3 THEN 'Medium' WHEN supply_demand_ratio IS NOT NULL THEN 'Low' END AS oversupply_risk,
  CASE WHEN price_yoy_change_pct < -10 THEN 'High' WHEN price_yoy_change_pct < 0 THEN 'Medium' WHEN price_yoy_change_pct IS NOT NULL THEN 'Low' END AS price_decline_risk FROM sd0),
opp0 AS (SELECT *, {SCORE} AS opportunity_score FROM sd WHERE supply_demand_ratio IS NOT NULL),
opp AS (SELECT area, opportunity_classification, market_balance, opportunity_score, supply_offplan_units, demand_offplan_tx, supply_demand_ratio, price_yoy_change_pct,
  supply_developers, {_band("opportunity_score", supply.TIMING_EDGES, supply.TIMING_LABELS)} AS investment_timing FROM opp0)
"""


def areas(spark, sf):
    return supply.supply_demand_areas(tables.transactions(spark, sf, "area"), _projects(spark, sf), 1999, 2000, YEARS)


SD_ROUND = "demand_price_per_sqm price_yoy_change_pct tx_yoy_change_pct supply_avg_completion_pct supply_demand_ratio tx_per_project units_per_developer"


@register("u1_supply_demand_areas", AREAS + "SELECT * REPLACE (CAST(supply_earliest_delivery AS VARCHAR) AS supply_earliest_delivery, CAST(supply_latest_delivery AS VARCHAR) AS supply_latest_delivery) FROM sd",
          r6=SD_ROUND, r4="demand_avg_price", r2="demand_volume_aed")
def u1(spark, sf):
    return _text(areas(spark, sf), "supply_earliest_delivery", "supply_latest_delivery")


PERFORMANCE = TX + "," + RAW.strip().removeprefix("WITH") + f""", dsup AS (
  SELECT developer, count(*) AS supply_projects, count(*) FILTER (is_offplan) AS supply_offplan_projects,
    count(*) FILTER (is_completed) AS supply_completed_projects, CAST(coalesce(sum(total_units) FILTER (is_offplan), 0) AS BIGINT) AS supply_offplan_units,
    avg(completion_percentage) AS supply_avg_completion_pct, count(DISTINCT master_development) AS supply_areas_active, count(DISTINCT property_type) AS supply_product_types
  FROM sp WHERE developer <> '' GROUP BY 1),
ddem AS (SELECT developer, count(*) AS demand_transaction_count, sum(actual_worth) AS demand_sales_volume, avg(actual_worth) AS demand_avg_price,
    count(*) FILTER (transaction_type = 'Off-Plan') AS demand_offplan_tx FROM tx WHERE transaction_year >= 1999 GROUP BY 1),
dj AS (SELECT developer, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("supply_projects", "supply_offplan_projects", "supply_completed_projects", "supply_offplan_units", "supply_areas_active", "supply_product_types", "demand_transaction_count", "demand_offplan_tx"))},
  supply_avg_completion_pct, demand_sales_volume, demand_avg_price FROM dsup FULL JOIN ddem USING (developer)),
dk AS (SELECT *, coalesce(supply_completed_projects * 100.0::DOUBLE / nullif(supply_projects, 0), 0) AS completion_rate_pct,
  coalesce(demand_offplan_tx * 100.0::DOUBLE / nullif(supply_offplan_units, 0), 0) AS sales_velocity_pct, least(100.0::DOUBLE, supply_areas_active * 10.0) AS geographic_diversification_score,
  least(100.0::DOUBLE, supply_product_types * 20.0) AS product_diversification_score FROM dj),
perf AS (SELECT *, CASE {" ".join(f"WHEN supply_completed_projects >= {c} AND completion_rate_pct >= {r} THEN '{n}'" for n, c, r in supply.TRACK_RECORD)} ELSE 'New Developer' END AS delivery_track_record FROM dk)
"""
PERF_ROUND = {"r6": "supply_avg_completion_pct completion_rate_pct sales_velocity_pct geographic_diversification_score product_diversification_score",
              "r4": "demand_avg_price", "r2": "demand_sales_volume"}


def performance(spark, sf):
    return supply.developer_performance(tables.transactions(spark, sf, "developer"), _projects(spark, sf), 1999)


@register("u2_developer_performance", PERFORMANCE + "SELECT * FROM perf", **PERF_ROUND)
def u2(spark, sf):
    return performance(spark, sf)


OPP_ROUND = "opportunity_score supply_demand_ratio price_yoy_change_pct"


@register("u3_market_opportunities", AREAS + "SELECT * FROM opp", r6=OPP_ROUND)
def u3(spark, sf):
    return supply.market_opportunities(areas(spark, sf))


QUARTERS = RAW + """, qa AS (SELECT delivery_index, delivery_quarter, master_development, count(*) AS p, sum(total_units) AS u, sum(residential_units) AS r, sum(commercial_units) AS c,
  sum(completion_percentage) AS pct FROM sp WHERE is_offplan GROUP BY 1, 2, 3),
qt AS (SELECT delivery_index, delivery_quarter, CAST(sum(p) AS BIGINT) AS projects_delivering, CAST(sum(u) AS BIGINT) AS total_units_delivering, CAST(sum(r) AS BIGINT) AS total_residential_units,
  CAST(sum(c) AS BIGINT) AS total_commercial_units, count(*) AS areas_delivering, sum(pct)::DOUBLE / sum(p) AS avg_completion_pct,
  arg_max(master_development, (u, master_development)) AS top_area_by_units FROM qa GROUP BY 1, 2)
"""


def quarters(spark, sf):
    return supply.supply_quarters(_projects(spark, sf))


@register("u4_supply_quarters", QUARTERS + "SELECT * FROM qt", r6="avg_completion_pct")
def u4(spark, sf):
    return quarters(spark, sf)


@register("u4_supply_timeline", RAW + """SELECT master_development, delivery_index, delivery_quarter, count(*) AS projects_delivering, CAST(sum(total_units) AS BIGINT) AS units_delivering,
  count(DISTINCT developer) AS active_developers FROM sp WHERE is_offplan GROUP BY 1, 2, 3""")
def u4b(spark, sf):
    return supply.supply_timeline(_projects(spark, sf))


@register("u5_supply_saturation", AREAS + """SELECT area, market_balance, supply_offplan_units, demand_offplan_tx, supply_demand_ratio, oversupply_risk, price_yoy_change_pct, tx_yoy_change_pct,
  supply_developers, near_term_supply, CASE WHEN supply_demand_ratio > 10 AND price_yoy_change_pct < -10 THEN 'CRITICAL' WHEN supply_demand_ratio > 5 AND price_yoy_change_pct < -5 THEN 'HIGH'
    WHEN supply_demand_ratio > 3 THEN 'MODERATE' ELSE 'LOW' END AS saturation_severity
FROM sd WHERE supply_demand_ratio > 3 AND supply_offplan_units >= 500""", r6="supply_demand_ratio price_yoy_change_pct tx_yoy_change_pct")
def u5(spark, sf):
    return supply.supply_saturation(areas(spark, sf))


@register("u6_supply_hotspots", AREAS + """SELECT area, opportunity_classification, market_balance, supply_offplan_projects, supply_offplan_units, demand_offplan_tx, supply_demand_ratio,
  price_yoy_change_pct, tx_yoy_change_pct, supply_developers, near_term_supply,
  tx_yoy_change_pct * 0.4 + price_yoy_change_pct * 0.3 + supply_developers * 2 + CASE WHEN supply_demand_ratio < 1 THEN 20 ELSE 0 END AS momentum_score
FROM sd WHERE supply_offplan_projects >= 1 AND tx_yoy_change_pct > -5 AND (supply_demand_ratio < 60 OR supply_demand_ratio IS NULL) AND supply_developers >= 1""",
          r6="supply_demand_ratio price_yoy_change_pct tx_yoy_change_pct momentum_score")
def u6(spark, sf):
    return supply.supply_hotspots(areas(spark, sf), min_projects=1, min_tx_growth=-5.0, max_ratio=60.0, min_developers=1)


@register("u7_developer_reliability", PERFORMANCE + """SELECT *, greatest(0.0, least(100.0, CASE delivery_track_record WHEN 'Highly Reliable' THEN 90.0 WHEN 'Reliable' THEN 75.0 WHEN 'Moderate' THEN 50.0
  WHEN 'Unproven' THEN 25.0 ELSE 10.0 END + completion_rate_pct * 0.1 + geographic_diversification_score * 0.5 - CASE WHEN sales_velocity_pct < 5 THEN 10.0 ELSE 0.0 END)) AS reliability_score
FROM perf WHERE supply_completed_projects >= 2""", **{**PERF_ROUND, "r6": PERF_ROUND["r6"] + " reliability_score"})
def u7(spark, sf):
    return supply.developer_reliability(performance(spark, sf))


WAVES = """SELECT *, round(total_units_delivering * 100.0::DOUBLE / (SELECT avg(total_units_delivering) FROM qt WHERE delivery_index >= 2001 * 4), 1) AS wave_intensity_pct
FROM qt WHERE delivery_index >= 2001 * 4 ORDER BY delivery_index LIMIT 8"""


@register("u8_delivery_waves", QUARTERS + WAVES, r6="avg_completion_pct")
def u8(spark, sf):
    return supply.delivery_waves(quarters(spark, sf), "Q1 2001")


@register("w7_wave_intensity", QUARTERS + f"SELECT delivery_quarter, total_units_delivering, wave_intensity_pct FROM ({WAVES.replace('LIMIT 8', 'LIMIT 4')})")
def w7(spark, sf):
    waves = supply.delivery_waves(quarters(spark, sf), "Q1 2001", ahead=4)
    return waves.select("delivery_quarter", "total_units_delivering", "wave_intensity_pct")


@register("u9_arbitrage_opportunities", AREAS + """SELECT area, opportunity_classification, market_balance, supply_offplan_units, demand_offplan_tx, supply_demand_ratio, price_yoy_change_pct,
  demand_avg_price, demand_price_per_sqm, supply_developers, near_term_supply, greatest(0.0, least(100.0, price_yoy_change_pct * 1.5 + (2.0 - coalesce(supply_demand_ratio, 2.0)) * 20
    + (10 - supply_developers) * 3 + CASE WHEN near_term_supply < 1000 THEN 15 ELSE 0 END)) AS arbitrage_score
FROM sd WHERE price_yoy_change_pct > -5 AND (supply_demand_ratio < 10 OR supply_demand_ratio IS NULL) AND supply_developers <= 20 AND demand_offplan_tx > 10""",
          r6="supply_demand_ratio price_yoy_change_pct demand_price_per_sqm arbitrage_score", r4="demand_avg_price")
def u9(spark, sf):
    return supply.arbitrage_opportunities(areas(spark, sf), min_price_growth=-5.0, max_ratio=10.0, max_developers=20)


def dossiers(spark, sf):
    projects = _projects(spark, sf)
    return supply.area_dossiers(areas(spark, sf), supply.supply_timeline(projects), projects, "Q1 2001")


TOP_DEVELOPERS = """, tdv AS (SELECT master_development AS area, developer, count(*) AS projects, CAST(sum(total_units) AS BIGINT) AS units,
  row_number() OVER (PARTITION BY master_development ORDER BY sum(total_units) DESC, developer) AS place FROM sp WHERE is_offplan AND developer <> '' GROUP BY 1, 2)"""


@register("u10_area_dossiers", AREAS + """, tl AS (SELECT master_development AS area, delivery_index, delivery_quarter, sum(total_units) AS u,
  row_number() OVER (PARTITION BY master_development ORDER BY delivery_index) AS place FROM sp WHERE is_offplan AND delivery_index >= 2001 * 4 GROUP BY 1, 2, 3)""" + TOP_DEVELOPERS + """
SELECT area, market_balance, supply_demand_ratio, opportunity_score, investment_timing,
  coalesce((SELECT array_to_string(list(delivery_quarter || '=' || u ORDER BY place), '; ') FROM tl WHERE tl.area = sd.area AND place <= 8), '') AS delivery_timeline,
  coalesce((SELECT array_to_string(list(developer || '=' || units ORDER BY place), '; ') FROM tdv WHERE tdv.area = sd.area AND place <= 5), '') AS top_developers
FROM sd LEFT JOIN (SELECT area, opportunity_score, investment_timing FROM opp) USING (area)""", r6="supply_demand_ratio opportunity_score")
def u10(spark, sf):
    df = dossiers(spark, sf)

    def listed(c, name, value):
        parts = F.transform(c, lambda s: F.concat_ws("=", s[name], s[value].cast("string")))
        return F.coalesce(F.array_join(parts, "; "), F.lit(""))

    return df.select(
        "area", "market_balance", "supply_demand_ratio", "opportunity_score", "investment_timing",
        listed("delivery_timeline", "delivery_quarter", "units_delivering").alias("delivery_timeline"),
        listed("top_developers", "developer", "units").alias("top_developers"),
    )


@register("u11_market_alerts", AREAS + """
SELECT * FROM (SELECT area, 'OVERSUPPLY' AS alert_type, CASE WHEN supply_demand_ratio > 10 THEN 'HIGH' ELSE 'MODERATE' END AS severity,
  supply_offplan_units || ' off-plan units meet ' || demand_offplan_tx || ' off-plan sales, ' || CAST(round(supply_demand_ratio, 1) AS DECIMAL(18, 1)) || ' units a sale' AS message
  FROM sd WHERE supply_demand_ratio > 3 AND supply_offplan_units > 500 ORDER BY supply_demand_ratio DESC, area LIMIT 10)
UNION ALL SELECT * FROM (SELECT area, 'OPPORTUNITY', CASE WHEN opportunity_score > 80 THEN 'HIGH' ELSE 'MODERATE' END,
  'scores ' || CAST(round(opportunity_score, 0) AS DECIMAL(18, 0)) || ' with ' || demand_offplan_tx || ' off-plan sales of ' || supply_offplan_units || ' off-plan units'
  FROM opp WHERE opportunity_classification IN ('High Opportunity', 'Moderate Opportunity') ORDER BY opportunity_score DESC, area LIMIT 5)
UNION ALL SELECT * FROM (SELECT area, 'RISK', 'HIGH', 'mean price moved by ' || CAST(round(price_yoy_change_pct, 1) AS DECIMAL(18, 1)) || '% in a year, ' || supply_offplan_units || ' units still to come'
  FROM sd WHERE price_yoy_change_pct < -2 AND demand_offplan_tx > 20 ORDER BY price_yoy_change_pct, area LIMIT 5)""")
def u11(spark, sf):
    table = areas(spark, sf)
    return supply.market_alerts(table, supply.market_opportunities(table), decline=-2.0)


@register("u12_balance_distribution", AREAS + f"""SELECT market_balance, count(*) AS areas, CAST(sum(supply_offplan_units) AS BIGINT) AS total_offplan_units, avg(supply_demand_ratio) AS avg_sd_ratio,
  CAST(list_position([{", ".join(f"'{n}'" for n in supply.BALANCE_LABELS)}], market_balance) AS INTEGER) AS balance_order FROM sd WHERE market_balance <> 'Insufficient Data' GROUP BY 1""", r6="avg_sd_ratio")
def u12(spark, sf):
    return supply.balance_distribution(areas(spark, sf))


@register("u12_supply_totals", AREAS + """SELECT count(*) AS total_areas, CAST(sum(supply_offplan_units) AS BIGINT) AS total_offplan_units, CAST(sum(demand_offplan_tx) AS BIGINT) AS total_offplan_transactions,
  avg(supply_demand_ratio) AS avg_supply_demand_ratio, count(*) FILTER (market_balance IN ('Oversupplied', 'Severely Oversupplied')) AS oversupplied_areas,
  count(*) FILTER (market_balance IN ('Undersupplied', 'Severely Undersupplied')) AS undersupplied_areas FROM sd""", r6="avg_supply_demand_ratio")
def u12b(spark, sf):
    return supply.supply_totals(areas(spark, sf))


@register("u13_areas_in_balance", AREAS + """SELECT area, supply_demand_ratio, supply_offplan_units, demand_offplan_tx, market_balance, opportunity_score, investment_timing, opportunity_classification,
  price_yoy_change_pct, supply_developers FROM opp WHERE market_balance = 'Severely Oversupplied'""", r6=OPP_ROUND)
def u13(spark, sf):
    table = areas(spark, sf)
    return supply.areas_in_balance(table, supply.market_opportunities(table), "Severely Oversupplied")


@register("u14_opportunity_ranking", AREAS + "SELECT * FROM opp ORDER BY opportunity_score DESC, area LIMIT 20", r6=OPP_ROUND)
def u14(spark, sf):
    return supply.opportunity_ranking(supply.market_opportunities(areas(spark, sf)))


@register("u15_opportunity_by_balance", AREAS + "SELECT market_balance, count(*) AS area_count, avg(opportunity_score) AS avg_opportunity, max(price_yoy_change_pct) AS max_price_growth FROM opp GROUP BY 1",
          r6="avg_opportunity max_price_growth")
def u15(spark, sf):
    table = areas(spark, sf)
    return supply.opportunity_by_balance(table, supply.market_opportunities(table))


@register("i7_project_profiles", AREAS + TOP_DEVELOPERS + """SELECT area, market_balance, supply_demand_ratio, demand_avg_price, price_yoy_change_pct, supply_offplan_units, supply_offplan_projects, supply_developers,
  near_term_supply, opportunity_classification, opportunity_score, investment_timing, CASE WHEN opportunity_score > 70 THEN 'High' WHEN opportunity_score > 40 THEN 'Moderate' ELSE 'Standard' END AS potential,
  coalesce((SELECT array_to_string(list(developer ORDER BY place), ', ') FROM tdv WHERE tdv.area = sd.area AND place <= 3), '') AS leading_developers
FROM sd LEFT JOIN (SELECT area, opportunity_score, investment_timing FROM opp) USING (area)""", r6="supply_demand_ratio price_yoy_change_pct opportunity_score", r4="demand_avg_price")
def i7(spark, sf):
    names = F.transform("leading_developers", lambda s: s["developer"])
    return supply.project_profiles(dossiers(spark, sf)).withColumn("leading_developers", F.coalesce(F.array_join(names, ", "), F.lit("")))
