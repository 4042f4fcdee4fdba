"""Registered queries: lookups and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from marketspark.catalog import intelligence_queries as intel
from marketspark.catalog import supply_queries as sup
from marketspark.catalog.metric_queries import M1, M3, MEDIAN, W1
from marketspark.catalog.registry import REGISTERED, TX, register
from marketspark.functions.expr import without_nan
from marketspark.functions.lineage import shared
from marketspark.functions.scale import one_row
from marketspark.operators import lookups, metrics
from marketspark.plans import bundles
from marketspark.sources import driver_tables as tables, sinks

AREAS = TX + f", m1 AS ({M1})"


def _areas(spark, sf):
    return metrics.area_metrics(tables.transactions(spark, sf, "area", "developer", "project", "type"))


@register("l1_areas", AREAS + """SELECT area_name_en, total_transactions, unique_projects, avg_price, median_price, avg_price_sqm, luxury_count, offplan_count, top_developers
FROM m1 WHERE total_transactions >= 1000 ORDER BY median_price DESC, area_name_en LIMIT 12""", r6="avg_price_sqm", r4="avg_price median_price")
def l1(spark, sf):
    out = lookups.areas(_areas(spark, sf), 1000, "median_price", 12)
    return out.select(
        "area_name_en", "total_transactions", "unique_projects", "avg_price", "median_price", "avg_price_sqm", "luxury_count",
        "offplan_count", "top_developers",
    )


DETAIL = TX + f""", m3 AS ({M3}), mo AS (SELECT *, row_number() OVER (PARTITION BY area_name_en ORDER BY transaction_year DESC, transaction_month DESC, property_type) AS row FROM m3 QUALIFY row <= 24)"""


@register("l2_area_months", DETAIL + "SELECT * FROM mo", r6="avg_price median_price avg_price_sqm")
def l2a(spark, sf):
    return lookups.area_months(metrics.monthly_trends(shared(tables.transactions(spark, sf, "area", "type"))))


@register("l2_area_projects", TX + """SELECT area_name_en, project_name_en, developer, transaction_type, count(*) AS tx_count, avg(actual_worth) AS avg_price,
  row_number() OVER (PARTITION BY area_name_en ORDER BY count(*) DESC, project_name_en, developer, transaction_type) AS row FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5 QUALIFY row <= 10""", r6="avg_price")
def l2b(spark, sf):
    out = lookups.area_projects(metrics.project_metrics(shared(tables.transactions(spark, sf))))
    return out.select("area_name_en", "project_name_en", "developer", "transaction_type", "tx_count", "avg_price", "row")


@register("l2_area_detail", TX + f""", m1 AS ({M1}), m3 AS ({M3})
SELECT 'metrics' AS part, area_name_en AS name, total_transactions AS tx_count, avg_price FROM m1 WHERE area_name_en = 'NATION_7'
UNION ALL SELECT * FROM (SELECT 'monthly_trends', transaction_year || '/' || transaction_month || '/' || property_type, tx_count, avg_price FROM m3 WHERE area_name_en = 'NATION_7'
  ORDER BY transaction_year DESC, transaction_month DESC, property_type LIMIT 24)
UNION ALL SELECT 'property_types', property_type || '/' || rooms_en, count(*), avg(actual_worth) FROM tx WHERE area_name_en = 'NATION_7' GROUP BY 2 HAVING count(*) >= 5
UNION ALL SELECT * FROM (SELECT 'top_projects', project_name_en || '/' || developer || '/' || transaction_type AS n, count(*) AS c, avg(actual_worth) FROM tx WHERE area_name_en = 'NATION_7'
  GROUP BY project_name_en, developer, transaction_type HAVING count(*) >= 5 ORDER BY c DESC, project_name_en, developer, transaction_type LIMIT 10)
UNION ALL SELECT 'offplan_comparison', area_name_en, count(*) FILTER (transaction_type = 'Off-Plan'), avg(actual_worth) FILTER (transaction_type = 'Off-Plan') FROM tx WHERE area_name_en = 'NATION_7' GROUP BY 2""",
          r4="avg_price")
def l2c(spark, sf):
    df = shared(tables.transactions(spark, sf))
    parts = lookups.area_detail(
        "NATION_7", metrics.area_metrics(df), metrics.monthly_trends(df), metrics.property_type_metrics(df), metrics.project_metrics(df),
        metrics.offplan_comparison(df),
    )
    names = {
        "metrics": ("area_name_en",), "monthly_trends": ("transaction_year", "transaction_month", "property_type"),
        "property_types": ("property_type", "rooms_en"), "top_projects": ("project_name_en", "developer", "transaction_type"),
        "offplan_comparison": ("area_name_en",),
    }
    out = None
    for part, df in parts.items():
        count = {"metrics": "total_transactions", "offplan_comparison": "offplan_count"}.get(part, "tx_count")
        price = "avg_offplan_price" if part == "offplan_comparison" else "avg_price"
        shown = df.select(F.lit(part).alias("part"), F.concat_ws("/", *names[part]).alias("name"), F.col(count).alias("tx_count"), F.col(price).alias("avg_price"))
        out = shown if out is None else out.unionByName(shown)
    return out


@register("l3_area_price_changes", TX + f", m3 AS ({M3}), w AS ({W1}) SELECT transaction_year, transaction_month, avg_price, pct_change_mom FROM w WHERE area_name_en = 'NATION_7' AND property_type = 'LARGE'",
          r6="avg_price pct_change_mom")
def l3(spark, sf):
    changes = metrics.month_over_month(metrics.monthly_trends(shared(tables.transactions(spark, sf, "area", "type"))))
    return lookups.price_changes(changes, "NATION_7", "LARGE").select("transaction_year", "transaction_month", "avg_price", "pct_change_mom")


@register("l4_luxury_months", TX + f"""SELECT area_name_en, transaction_year, transaction_month, count(*) AS luxury_tx_count, avg(actual_worth) AS avg_luxury_price, {MEDIAN} AS median_luxury_price
FROM tx WHERE is_luxury AND transaction_year = 2000 GROUP BY 1, 2, 3 HAVING count(*) >= 4""", r6="avg_luxury_price median_luxury_price")
def l4(spark, sf):
    out = lookups.luxury_months(metrics.luxury_monthly(shared(tables.transactions(spark, sf, "area", "developer", "project"))), 2000, 4)
    return out.select("area_name_en", "transaction_year", "transaction_month", "luxury_tx_count", "avg_luxury_price", "median_luxury_price")


@register("l4_luxury_areas", TX + """SELECT area_name_en, count(*) AS total_luxury_transactions, max(actual_worth) AS highest_sale FROM tx WHERE is_luxury GROUP BY 1 HAVING count(*) >= 5
ORDER BY 2 DESC, 1 LIMIT 10""")
def l4b(spark, sf):
    out = lookups.luxury_areas(metrics.luxury_summary(tables.transactions(spark, sf, "area", "developer", "project")), 10)
    return out.select("area_name_en", "total_luxury_transactions", "highest_sale")


@register("l5_developers", TX + """SELECT developer, count(*) AS total_transactions, sum(actual_worth) AS total_sales_volume FROM tx GROUP BY 1 HAVING count(*) >= 300 ORDER BY 2 DESC, 1 LIMIT 50""", r2="total_sales_volume")
def l5(spark, sf):
    out = lookups.developers(metrics.developer_metrics(shared(tables.transactions(spark, sf, "area", "developer", "project"))), 300)
    return out.select("developer", "total_transactions", "total_sales_volume")


@register("l5_developer_detail", TX + """SELECT project_name_en, area_name_en, transaction_type, count(*) AS tx_count, avg(actual_worth) AS avg_price FROM tx WHERE developer = 'Supplier#000000007'
GROUP BY 1, 2, 3 HAVING count(*) >= 5 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20""", r6="avg_price")
def l5b(spark, sf):
    df = shared(tables.transactions(spark, sf))
    detail = lookups.developer_detail("Supplier#000000007", metrics.developer_metrics(df), metrics.project_metrics(df))
    return detail["projects"].select("project_name_en", "area_name_en", "transaction_type", "tx_count", "avg_price")


@register("l5_developer_metrics", TX + """SELECT developer, count(*) AS total_transactions, sum(actual_worth) AS total_sales_volume FROM tx WHERE developer = 'Supplier#000000007'
GROUP BY 1""", r2="total_sales_volume")
def l5c(spark, sf):
    df = shared(tables.transactions(spark, sf))
    detail = lookups.developer_detail("Supplier#000000007", metrics.developer_metrics(df), metrics.project_metrics(df))
    return detail["metrics"].select("developer", "total_transactions", "total_sales_volume")


@register("l6_projects", TX + """SELECT project_name_en, developer, area_name_en, transaction_type, count(*) AS tx_count FROM tx WHERE transaction_type = 'Off-Plan' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 6
ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 50""")
def l6(spark, sf):
    out = lookups.projects(metrics.project_metrics(shared(tables.transactions(spark, sf))), sale_type="Off-Plan", min_transactions=6)
    return out.select("project_name_en", "developer", "area_name_en", "transaction_type", "tx_count")


@register("l7_offplan_summary", TX + f"""SELECT count(*) AS total_offplan, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price, count(DISTINCT area_name_en) AS areas, count(DISTINCT project_name_en) AS projects
FROM tx WHERE transaction_type = 'Off-Plan'""", r4="avg_price median_price")
def l7(spark, sf):
    return lookups.offplan_summary(tables.transactions(spark, sf, "area", "project"))


@register("l7_offplan_areas", TX + """SELECT area_name_en, count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_count, count(*) FILTER (transaction_type = 'Existing') AS ready_count FROM tx GROUP BY 1
HAVING count(*) >= 20 AND offplan_count > 100 ORDER BY 2 DESC, 1 LIMIT 15""")
def l7b(spark, sf):
    out = lookups.offplan_areas(metrics.offplan_comparison(tables.transactions(spark, sf, "area")))
    return out.select("area_name_en", "offplan_count", "ready_count")


@register("l8_transactions", TX + """SELECT transaction_id, CAST(instance_date AS VARCHAR) AS instance_date, area_name_en, property_type, actual_worth FROM tx
WHERE area_name_en = 'NATION_7' AND property_type = 'LARGE' AND transaction_year = 2000 AND actual_worth BETWEEN 20000 AND 90000 ORDER BY instance_date DESC, transaction_id LIMIT 100""")
def l8(spark, sf):
    out = lookups.transactions(tables.transactions(spark, sf, "area", "type"), "NATION_7", 20_000, 90_000, "LARGE", 2000)
    return out.select("transaction_id", F.col("instance_date").cast("string").alias("instance_date"), "area_name_en", "property_type", "actual_worth")


@register("l9_yearly_volume", TX + "SELECT transaction_year, count(*) AS transactions, avg(actual_worth) AS avg_price FROM tx GROUP BY 1", r4="avg_price")
def l9(spark, sf):
    return lookups.yearly_volume(tables.transactions(spark, sf, "area"))


@register("l9_monitoring_totals", TX + "SELECT count(*) AS total_tx, count(DISTINCT area_name_en) AS total_areas, count(*) FILTER (is_luxury) AS luxury_tx, max(transaction_year) AS latest_year FROM tx")
def l9b(spark, sf):
    return lookups.monitoring_totals(tables.transactions(spark, sf, "area"))


@register("l10_room_comparison", TX + """, m5 AS (SELECT area_name_en, property_type, rooms_en, count(*) AS n, avg(actual_worth) AS p, avg(meter_sale_price) AS s, avg(procedure_area) AS z FROM tx GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT rooms_en, count(DISTINCT area_name_en) AS areas_available, CAST(sum(n) AS BIGINT) AS total_transactions, avg(p) AS avg_price, avg(s) AS avg_price_sqm, avg(z) AS avg_size_sqm
FROM m5 WHERE rooms_en IN ('1 B/R', '2 B/R', '3 B/R') GROUP BY 1""", r6="avg_price_sqm avg_size_sqm", r4="avg_price")
def l10(spark, sf):
    table = metrics.property_type_metrics(tables.transactions(spark, sf, "area", "type", "rooms"))
    return lookups.room_comparison(table, ["1 B/R", "2 B/R", "3 B/R"])


@register("l11_clean_numbers", TX + """SELECT transaction_id, CASE WHEN transaction_month = 1 THEN NULL WHEN transaction_month = 2 THEN NULL ELSE meter_sale_price END AS value FROM tx""")
def l11(spark, sf):
    month = F.col("transaction_month")
    raw = F.when(month == 1, F.lit(float("nan"))).when(month == 2, F.lit(float("-inf"))).otherwise(F.col("meter_sale_price"))
    return tables.transactions(spark, sf, "area").select("transaction_id", without_nan(raw).alias("value"))


def _inner(name):
    return REGISTERED[name].sql


def _sections(parts):
    """SQL that lines up registered queries as (section, name, value)."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({name} AS VARCHAR) AS name, CAST({value} AS DOUBLE) AS value FROM ({_inner(query)})"
        for section, query, name, value in parts)


def _stacked(frames):
    out = None
    for section, (df, name, value) in frames.items():
        part = df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out




def _report(spark, sf):
    return bundles.market_report(tables.transactions(spark, sf), intel.Q2, intel.SEASON_START, tables.SAMPLE, max_discount=-1.0)


@register("i1_market_report", TX + f"""SELECT 'record_transactions' AS section, CAST(transaction_id AS VARCHAR) AS name, actual_worth AS value FROM ({_inner("a1_record_sales")})
UNION ALL SELECT 'ultra_luxury_records', transaction_id, actual_worth FROM ({_inner("a2_ultra_luxury_records")})
UNION ALL SELECT * FROM (SELECT 'new_developers', developer, count(*) FILTER ({intel.IN_Q2}) AS n FROM tx GROUP BY 2 HAVING min(instance_date) >= DATE '1999-04-01' AND n >= 5 ORDER BY n DESC, developer LIMIT 10)
UNION ALL SELECT 'segment_distribution', {intel.SEGMENT.format("actual_worth")}, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () FROM tx WHERE {intel.IN_Q2} GROUP BY 2
UNION ALL SELECT 'market_concentration', 'area_name_en', sum(n) FILTER (rn <= 5) * 100.0::DOUBLE / sum(n) FROM (SELECT area_name_en, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, area_name_en) AS rn FROM tx WHERE {intel.IN_Q2} GROUP BY 1)
UNION ALL SELECT 'market_concentration', 'developer', sum(n) FILTER (rn <= 5) * 100.0::DOUBLE / sum(n) FROM (SELECT developer, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, developer) AS rn FROM tx WHERE {intel.IN_Q2} GROUP BY 1)""", r6="value")
def i1(spark, sf):
    report = _report(spark, sf)
    return _stacked(
        {
            "record_transactions": (report["record_transactions"], "transaction_id", "actual_worth"),
            "ultra_luxury_records": (report["ultra_luxury_records"], "transaction_id", "actual_worth"),
            "new_developers": (report["new_developers"], "developer", "transaction_count"),
            "segment_distribution": (report["segment_distribution"], "segment", "pct"),
            "market_concentration": (report["market_concentration"], "dimension", "top_5_share"),
        }
    )


GUIDE_COLUMNS = (
    "total_transactions", "avg_price", "market_segment", "trajectory", "momentum_3m", "volume_trend", "peak_months", "phase",
    "comparable_areas", "market_balance", "opportunity_score", "investment_timing",
)


@register("i2_area_guides", f"""SELECT area_name_en, total_transactions, avg_price, market_segment, trajectory, momentum_3m, volume_trend, peak_months, phase, comparable_areas, market_balance, opportunity_score, investment_timing
FROM ({_inner("c1_area_dna")}) JOIN (SELECT * EXCLUDE (current_avg_price) FROM ({_inner("t6_combined_trends")})) USING (area_name_en) LEFT JOIN ({_inner("u10_area_dossiers")}) d ON d.area = area_name_en""")
def i2(spark, sf):
    df = tables.transactions(spark, sf)
    guide = bundles.area_guides(df, intel.AS_OF, intel.SEASON_START, intel.EDGES, sup.dossiers(spark, sf).select("area", "market_balance", "opportunity_score", "investment_timing"))
    out = guide.withColumn("comparable_areas", F.array_join("comparable_areas", ", ")).select("area_name_en", *GUIDE_COLUMNS)
    step = 0.025
    return out.withColumns(
        {
            "avg_price": F.round(F.col("avg_price") + step * 1e-4, 4),
            "momentum_3m": F.round(F.col("momentum_3m") + step * 1e-6, 6),
            "opportunity_score": F.round(F.col("opportunity_score") + step * 1e-6, 6),
        }
    )


@register("i3_developer_intelligence", TX + intel.DEVELOPERS + intel.MOMENTUM + "SELECT dp.*, current_share, previous_share, share_change, trend, focus_areas FROM dp LEFT JOIN mo USING (developer)",
          r6="offplan_pct market_share current_share previous_share share_change", r4="avg_transaction_value")
def i3(spark, sf):
    return bundles.developer_intelligence(tables.transactions(spark, sf, "area", "developer"), intel.Q2, intel.EDGES, 8, 0.3)


@register("i4_luxury_intelligence", TX + f"""SELECT 'record_transactions' AS section, CAST(transaction_id AS VARCHAR) AS name, actual_worth AS value FROM ({_inner("a1_record_sales")})
UNION ALL SELECT 'ultra_luxury_records', transaction_id, actual_worth FROM ({_inner("a2_ultra_luxury_records")})
UNION ALL SELECT * FROM (SELECT 'luxury_share', {intel.SEGMENT.format("actual_worth")} AS s, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () FROM tx WHERE {intel.IN_Q2} GROUP BY 2) WHERE s IN ('luxury', 'ultra_luxury')""", r6="value")
def i4(spark, sf):
    bundle = bundles.luxury_intelligence(tables.transactions(spark, sf, "area", "type"), intel.Q2, tables.SAMPLE)
    return _stacked(
        {
            "record_transactions": (bundle["record_transactions"], "transaction_id", "actual_worth"),
            "ultra_luxury_records": (bundle["ultra_luxury_records"], "transaction_id", "actual_worth"),
            "luxury_share": (bundle["luxury_share"], "segment", "pct"),
        }
    )


# January 2000 against 1999 has areas and developers above the default thresholds.
def _shift_cte(key, name):
    """Activity of the second quarter per month against the twelve months before."""
    before = "instance_date >= DATE '1999-04-01' AND instance_date < DATE '2000-04-01'"
    return intel._shift(key, intel.IN_Q2, before, 12, 3).replace("g AS (", f"{name}_g AS (").replace(" FROM g)", f" FROM {name}_g)").replace("\ns AS (", f"\n{name} AS (")


# The other findings of the same report: moves of areas and developers, and the market's trends on its last day.
@register("i1_market_report_moves", TX + _shift_cte("area_name_en", "areas") + _shift_cte("developer", "developers") + f"""
SELECT * FROM (SELECT 'volume_spikes' AS section, area_name_en AS name, change_pct AS value FROM areas WHERE historical_monthly_avg > 5 AND current_count > 0 AND change_pct >= 30 ORDER BY change_pct DESC, area_name_en LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'volume_drops', area_name_en, change_pct FROM areas WHERE historical_monthly_avg > 10 AND change_pct <= -30 ORDER BY change_pct, area_name_en LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'developer_surges', developer, change_pct FROM developers WHERE historical_monthly_avg >= 10 AND current_count > 0 AND change_pct >= 50 ORDER BY change_pct DESC, developer LIMIT 10)
UNION ALL SELECT 'emerging_hotspots', area_name_en, momentum_score FROM ({_inner("o1_emerging_hotspots").replace("tx_growth >= 5", "tx_growth >= 15")})
UNION ALL SELECT 'price_arbitrage', property_type || '/' || rooms_en, arbitrage_pct FROM ({_inner("o3_price_arbitrage").replace(intel.IN_YEAR, intel.IN_Q2).replace("HAVING count(*) >= 6", "HAVING count(*) >= 10")})
UNION ALL SELECT 'undervalued_areas', area_name_en, price_discount FROM ({_inner("o2_undervalued_areas").replace(intel.IN_YEAR, intel.IN_Q2)})
UNION ALL SELECT 'developer_momentum', developer, share_change FROM ({_inner("o4_developer_momentum").replace("current_tx >= 8", "current_tx >= 20")})""", r6="value")
def i1b(spark, sf):
    report = _report(spark, sf)
    arbitrage = report["price_arbitrage"].withColumn("kind", F.concat_ws("/", "property_type", "rooms_en"))
    return _stacked(
        {
            "volume_spikes": (report["volume_spikes"], "area_name_en", "change_pct"),
            "volume_drops": (report["volume_drops"], "area_name_en", "change_pct"),
            "developer_surges": (report["developer_surges"], "developer", "change_pct"),
            "emerging_hotspots": (report["emerging_hotspots"], "area_name_en", "momentum_score"),
            "price_arbitrage": (arbitrage, "kind", "arbitrage_pct"),
            "undervalued_areas": (report["undervalued_areas"], "area_name_en", "price_discount"),
            "developer_momentum": (report["developer_momentum"], "developer", "share_change"),
        }
    )


_WHOLE = ", whole AS (SELECT * REPLACE ('market' AS area_name_en) FROM tx)"
_TRENDS = intel.COMBINED.replace("FROM tx ", "FROM whole ").replace("FROM tx\n", "FROM whole\n").replace("2000-12-01", "2000-07-01").replace("2000-10-01", "2000-07-01").replace("mn = 11", "mn = 6")


@register("i1_market_report_trends", TX + _WHOLE + _TRENDS + f"SELECT * EXCLUDE (area_name_en) FROM {intel.COMBINED_SELECT}", **intel.TREND_ROUND)
def i1c(spark, sf):
    report = _report(spark, sf)
    return one_row([report[part] for part in ("price_momentum", "volume_momentum", "seasonality", "market_cycle")])


@register("i5_offplan_intelligence", TX + intel._shift("area_name_en", intel.IN_JUNE, intel.BEFORE_JUNE, 12) + f""", gd AS (SELECT developer, count(*) FILTER ({intel.IN_JUNE}) AS c, count(*) FILTER ({intel.BEFORE_JUNE}) / 12.0::DOUBLE AS h FROM tx GROUP BY 1),
hs AS (SELECT area_name_en, count(*) FILTER ({intel.IN_JUNE}) AS c, count(*) FILTER (instance_date >= DATE '2000-05-02' AND instance_date < DATE '2000-06-01') AS p,
  avg(actual_worth) FILTER ({intel.IN_JUNE}) AS cp, avg(actual_worth) FILTER (instance_date >= DATE '2000-05-02' AND instance_date < DATE '2000-06-01') AS pp FROM tx GROUP BY 1)
SELECT * FROM (SELECT 'volume_spikes' AS section, area_name_en AS name, change_pct AS value FROM s WHERE historical_monthly_avg > 5 AND current_count > 0 AND change_pct >= 30 ORDER BY change_pct DESC, area_name_en LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'new_developers', developer, count(*) FILTER ({intel.IN_JUNE}) AS n FROM tx WHERE developer <> '' GROUP BY 2 HAVING min(instance_date) >= DATE '1999-06-01' AND n >= 5 ORDER BY n DESC, developer LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'developer_surges', developer, (c - h) / h * 100 AS x FROM gd WHERE h >= 10 AND x >= 50 ORDER BY x DESC, developer LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'emerging_hotspots', area_name_en, (c - p)::DOUBLE / p * 100 * 0.6 + (cp - pp) / pp * 100 * 0.4 AS x FROM hs WHERE c >= 20 AND p >= 10 AND (c - p)::DOUBLE / p * 100 >= 15 AND cp > pp ORDER BY x DESC, area_name_en LIMIT 10)""",
          r6="value")
def i5(spark, sf):
    bundle = bundles.offplan_intelligence(tables.transactions(spark, sf, "area", "developer"), intel.JUNE)
    return _stacked(
        {
            "new_developers": (bundle["new_developers"], "developer", "transaction_count"),
            "volume_spikes": (bundle["volume_spikes"], "area_name_en", "change_pct"),
            "developer_surges": (bundle["developer_surges"], "developer", "change_pct"),
            "emerging_hotspots": (bundle["emerging_hotspots"], "area_name_en", "momentum_score"),
        }
    )


@register("i6_supply_forecast", f"""SELECT 'delivery_waves' AS section, delivery_quarter AS name, wave_intensity_pct AS value FROM ({_inner("u8_delivery_waves")})
UNION ALL SELECT * FROM (SELECT 'saturation', area, supply_demand_ratio FROM ({_inner("u5_supply_saturation")}) ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'hotspots', area, momentum_score FROM ({_inner("u6_supply_hotspots")})
UNION ALL SELECT 'alerts', area || ' ' || alert_type || ' ' || severity || ': ' || message, NULL FROM ({_inner("u11_market_alerts")})""", r6="value")
def i6(spark, sf):
    limits = {"min_projects": 1, "min_tx_growth": -5.0, "max_ratio": 60.0, "min_developers": 1}
    bundle = bundles.supply_forecast(sup.areas(spark, sf), sup.quarters(spark, sf), "Q1 2001", hotspot_limits=limits, decline=-2.0)
    said = F.concat("area", F.lit(" "), "alert_type", F.lit(" "), "severity", F.lit(": "), "message")
    alerts = bundle["alerts"].select(said.alias("alert"), F.lit(None).cast("double").alias("value"))
    return _stacked(
        {
            "delivery_waves": (bundle["delivery_waves"], "delivery_quarter", "wave_intensity_pct"),
            "saturation": (bundle["saturation"], "area", "supply_demand_ratio"),
            "hotspots": (bundle["hotspots"], "area", "momentum_score"),
            "alerts": (alerts, "alert", "value"),
        }
    )


# The registered query behind each finding, and which of its serialised fields are broken numbers or texts; the others are counts.
FINDINGS = {
    "record_transactions": "a1_record_sales",
    "volume_spikes": "a3_volume_spikes",
    "new_developers": "a5_new_developers",
    "emerging_hotspots": "o1_emerging_hotspots",
    "undervalued_areas": "o2_undervalued_areas",
    "developer_momentum": "o4_developer_momentum",
    "price_momentum": "t1_price_momentum_mid_month",
    "market_cycle": "t5_market_cycle",
}
BROKEN = {
    "actual_worth", "change_pct", "total_value", "tx_growth", "price_growth", "price_discount", "avg_price_sqm", "share_change", "momentum_3m", "momentum_6m",
    "momentum_12m", "phase_confidence",
}
TEXTS = {"area_name_en", "property_type", "developer", "trend", "trajectory", "phase"}
NUDGE = 0.025e-4  # as in register: halves of the last place go one way on both sides


def _field(name):
    if name in TEXTS:
        return f"""'"{name}":"' || {name} || '"'"""
    value = f"CAST(round(CAST({name} AS DOUBLE) + {NUDGE!r}, 4) AS DECIMAL(24, 4))" if name in BROKEN else name
    return f"""'"{name}":' || {value}"""


@register("i8_serialised_findings", " UNION ALL ".join(
    f"SELECT '{finding}' AS finding, '{{' || concat_ws(',', {', '.join(map(_field, bundles.SERIALISED[finding]))}) || '}}' AS value FROM ({_inner(query)})"
    for finding, query in FINDINGS.items()))
def i8(spark, sf):
    found = {finding: REGISTERED[query].build(spark, sf) for finding, query in FINDINGS.items()}
    bundle = {
        finding: df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(NUDGE), 4) for c in df.columns if c in BROKEN})
        for finding, df in found.items()
    }
    return bundles.serialised(bundle)


@register("d12_chart_data", TX + """SELECT 'monthly_trend' AS section, CAST(transaction_month AS VARCHAR) AS name, count(*)::DOUBLE AS value FROM tx WHERE transaction_year = 2000 GROUP BY 2
UNION ALL SELECT 'market_segments', transaction_type, count(*) FROM tx WHERE transaction_year = 2000 GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'top_areas', area_name_en, count(*) FROM tx WHERE transaction_year = 2000 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def d12(spark, sf):
    data = bundles.chart_data(tables.transactions(spark, sf, "area", "developer", "type"), "market", 2000)
    return _stacked(
        {
            "monthly_trend": (data["monthly_trend"], "transaction_month", "transaction_count"),
            "market_segments": (data["market_segments"], "segment", "tx_count"),
            "top_areas": (data["top_areas"], "name", "transaction_count"),
        }
    )


def _chart_sql(kind, segment, mix, names, name_column):
    """Trend, mix and leading names of one kind of report in 2000."""
    only = f" AND {segment}" if segment else ""
    trend, parts, top = names
    mixed = f"UNION ALL SELECT '{kind}', '{parts}', {mix}, count(*) FROM tx WHERE transaction_year = 2000 GROUP BY 3" if mix else ""
    return f"""SELECT '{kind}' AS report, '{trend}' AS section, CAST(transaction_month AS VARCHAR) AS name, count(*)::DOUBLE AS value FROM tx WHERE transaction_year = 2000{only} GROUP BY 3
{mixed} UNION ALL SELECT * FROM (SELECT '{kind}', '{top}', {name_column}, count(*) FROM tx WHERE transaction_year = 2000{only} GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 10)"""


OFFPLAN_ONLY = "transaction_type = 'Off-Plan'"
CHART_SQL = " UNION ALL ".join(
    _chart_sql(*c) for c in (
        ("luxury", "is_luxury", None, ("luxury_trend", "", "top_luxury_areas"), "area_name_en"),
        ("offplan", OFFPLAN_ONLY, "transaction_type", ("offplan_trend", "offplan_vs_ready", "developer_pipeline"), "developer"),
        ("area_guide", None, "property_type", ("price_trend", "property_types", "developer_share"), "developer"),
        ("developer", None, None, ("transaction_volume", "", "project_areas"), "area_name_en"),
    )
)


@register("d12_chart_data_of_reports", TX + CHART_SQL)
def d12b(spark, sf):
    sales = tables.transactions(spark, sf, "area", "developer", "type")
    out = None
    for report in ("luxury", "offplan", "area_guide", "developer"):
        for section, df in bundles.chart_data(sales, report, 2000).items():
            name = next(c for c in ("transaction_month", "segment", "name") if c in df.columns)
            count = next(c for c in ("transaction_count", "tx_count") if c in df.columns)
            part = df.select(F.lit(report).alias("report"), F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(count).cast("double").alias("value"))
            if section != "luxury_tiers":  # its bands are checked by d5
                out = part if out is None else out.unionByName(part)
    return out


SIZES = {
    "metrics_area": M1, "metrics_monthly_trends": M3,
    "metrics_area_developers": "SELECT DISTINCT area_name_en, developer FROM tx",
    "metrics_luxury_summary": "SELECT 1 FROM tx WHERE is_luxury GROUP BY area_name_en HAVING count(*) >= 5",
    "metrics_property_types": "SELECT 1 FROM tx GROUP BY area_name_en, property_type, rooms_en HAVING count(*) >= 5",
    "metrics_projects": "SELECT 1 FROM tx GROUP BY project_name_en, developer, area_name_en, transaction_type HAVING count(*) >= 5",
    "metrics_developers": "SELECT 1 FROM tx GROUP BY developer HAVING count(*) >= 10",
    "metrics_offplan": "SELECT 1 FROM tx GROUP BY area_name_en, transaction_year, transaction_month, transaction_type HAVING count(*) >= 3",
    "metrics_offplan_comparison": "SELECT 1 FROM tx GROUP BY area_name_en HAVING count(*) >= 20",
}


@register("m17_metric_table_sizes", TX + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM ({q})" for n, q in SIZES.items()))
def m17(spark, sf):
    built = bundles.metric_tables(shared(tables.transactions(spark, sf)))
    out = None
    for name in SIZES:
        part = built[name].agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# What each sink writes, as rows; the writing itself is tested with folders in tests/test_sources.py.
@register("s5_version_rows", TX + """SELECT 7 AS version_id, transaction_year, count(*) AS records, sum(actual_worth) AS volume FROM tx GROUP BY 2""", r2="volume")
def s5(spark, sf):
    rows = sinks.stamped(tables.transactions(spark, sf, "area"), 7)
    return rows.groupBy("version_id", "transaction_year").agg(F.count(F.lit(1)).alias("records"), F.sum("actual_worth").alias("volume"))


@register("s6_metric_table_rows", AREAS + "SELECT area_name_en, total_transactions, luxury_count, offplan_count FROM m1")
def s6(spark, sf):
    return _areas(spark, sf).select("area_name_en", "total_transactions", "luxury_count", "offplan_count")


@register("s7_csv_lines", TX + """SELECT area_name_en || ',' || property_type || ',' || count(*) || ',' || count(DISTINCT developer) AS line FROM tx GROUP BY area_name_en, property_type""")
def s7(spark, sf):
    df = tables.transactions(spark, sf, "area", "developer", "type").groupBy("area_name_en", "property_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("developer").alias("d")
    )
    return df.select(F.to_csv(F.struct("area_name_en", "property_type", "n", "d")).alias("line"))


@register("s8_study_export", intel.STUDY + """SELECT name, transactions_1, transactions_2, CASE WHEN growth_2_pct = 999999 THEN 'INFINITE' ELSE CAST(CAST(growth_2_pct AS DECIMAL(22, 2)) AS VARCHAR) END AS growth_2_pct,
  misleading_reason FROM flagged""")
def s8(spark, sf):
    return sinks.shown_study(intel._flagged(spark, sf)).select("name", "transactions_1", "transactions_2", "growth_2_pct", "misleading_reason")


@register("s9_slice_sizes", intel.STUDY + """SELECT 'all' AS slice, count(*) AS records FROM flagged UNION ALL SELECT 'top_legitimate', least(50, count(*)) FROM flagged WHERE NOT misleading_flag
UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'misleading', count(*) FROM flagged WHERE misleading_flag UNION ALL SELECT 'high_volume', count(*) FROM flagged WHERE transactions_2 > 12
UNION ALL SELECT 'declining', count(*) FROM flagged WHERE compound_growth_pct < -10""")
def s9(spark, sf):
    from marketspark.operators.opportunities import study_slices

    out = None
    for name, df in study_slices(intel._flagged(spark, sf), high_volume=12, years=intel.YEARS).items():
        part = df.agg(F.count(F.lit(1)).alias("records")).withColumn("slice", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


TYPED = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()), T.StructField("area_name_en", T.StringType()), T.StructField("actual_worth", T.LongType()),
        T.StructField("procedure_area", T.IntegerType()), T.StructField("is_luxury", T.StringType()),
    ]
)


@register("s10_typed_rows", TX + """SELECT transaction_id, area_name_en, CAST(trunc(actual_worth) AS BIGINT) AS actual_worth, CAST(procedure_area AS INTEGER) AS procedure_area, CAST(is_luxury AS VARCHAR) AS is_luxury FROM tx""")
def s10(spark, sf):
    return sinks.typed(tables.transactions(spark, sf, "area"), TYPED)
