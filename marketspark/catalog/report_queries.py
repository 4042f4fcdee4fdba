"""Registered queries: periods, reports, chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.metric_queries import M12, MEDIAN
from marketspark.catalog.registry import TX, register
from marketspark.functions.periods import Period
from marketspark.functions.lineage import shared
from marketspark.operators import charts, metrics, reports
from marketspark.sources import driver_tables as tables

Q2, Q1 = Period(2000, "quarterly", 2), Period(2000, "quarterly", 1)
IN_Q2 = "instance_date >= DATE '2000-04-01' AND instance_date < DATE '2000-07-01'"
IN_Q1 = "instance_date >= DATE '2000-01-01' AND instance_date < DATE '2000-04-01'"
OFF, RDY = "transaction_type = 'Off-Plan'", "transaction_type = 'Existing'"

MEASURES = f"""count(*) AS total_transactions, count(DISTINCT area_name_en) AS unique_areas, count(DISTINCT project_name_en) AS unique_projects,
  count(DISTINCT developer) AS unique_developers, coalesce(sum(actual_worth), 0) AS total_sales_volume, avg(actual_worth) AS avg_price,
  min(actual_worth) AS min_price, max(actual_worth) AS max_price, stddev_samp(actual_worth) AS price_stddev, avg(procedure_area) AS avg_size_sqm,
  avg(meter_sale_price) AS avg_price_per_sqm, count(*) FILTER (is_luxury) AS luxury_count, coalesce(sum(actual_worth) FILTER (is_luxury), 0) AS luxury_volume,
  count(*) FILTER ({OFF}) AS offplan_count, coalesce(sum(actual_worth) FILTER ({OFF}), 0) AS offplan_volume,
  count(*) FILTER ({RDY}) AS ready_count, coalesce(sum(actual_worth) FILTER ({RDY}), 0) AS ready_volume,
  {MEDIAN} AS median_price, quantile_cont(actual_worth, 0.25) AS price_q1, quantile_cont(actual_worth, 0.75) AS price_q3,
  quantile_cont(meter_sale_price, 0.5) AS median_price_per_sqm"""
DERIVED = """coalesce(total_sales_volume / nullif(total_transactions, 0), 0) AS avg_transaction_size, coalesce(max_price - min_price, 0) AS price_range,
  coalesce(price_q3 - price_q1, 0) AS price_iqr, coalesce(price_stddev * 100 / avg_price, 0) AS coefficient_of_variation,
  coalesce(luxury_count * 100.0::DOUBLE / nullif(total_transactions, 0), 0) AS luxury_percentage, coalesce(luxury_volume / nullif(luxury_count, 0), 0) AS luxury_avg_price,
  coalesce(offplan_count * 100.0::DOUBLE / nullif(total_transactions, 0), 0) AS offplan_percentage, coalesce(offplan_volume / nullif(offplan_count, 0), 0) AS offplan_avg_price,
  coalesce(ready_count * 100.0::DOUBLE / nullif(total_transactions, 0), 0) AS ready_percentage, coalesce(ready_volume / nullif(ready_count, 0), 0) AS ready_avg_price"""
ROUND = {
    "r6": "avg_size_sqm avg_price_per_sqm median_price_per_sqm luxury_percentage offplan_percentage ready_percentage",
    "r4": "avg_price median_price price_q1 price_q3 price_stddev avg_transaction_size price_range price_iqr coefficient_of_variation luxury_avg_price offplan_avg_price ready_avg_price",
    "r2": "total_sales_volume luxury_volume offplan_volume ready_volume",
}


def _all(spark, sf):
    return tables.transactions(spark, sf, "area", "developer", "project", "type")


@register("p1_period_ranges", TX + """
SELECT CAST(year(d) AS INTEGER) AS period_year, CAST((month(d) - 1) // 6 + 1 AS INTEGER) AS period_number, count(*) AS tx_count,
  CAST(min(make_date(year(d), ((month(d) - 1) // 6) * 6 + 1, 1)) AS VARCHAR) AS period_start,
  CAST(CAST(min(make_date(year(d), ((month(d) - 1) // 6) * 6 + 1, 1)) + INTERVAL 6 MONTH AS DATE) AS VARCHAR) AS period_end
FROM (SELECT instance_date AS d FROM tx) GROUP BY 1, 2""")
def p1(spark, sf):
    df = reports.periods_of(tables.transactions(spark, sf, "area"), "semi_annual")
    return df.select(
        "period_year", "period_number", "tx_count",
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"),
    )


@register("p2_neighbour_periods", TX + """, q AS (
  SELECT CAST(year(instance_date) * 4 + quarter(instance_date) - 1 AS INTEGER) AS period_index, count(*) AS tx_count, sum(actual_worth) AS volume FROM tx GROUP BY 1)
SELECT q.*, coalesce(p.tx_count, 0) AS previous_tx_count, coalesce(y.tx_count, 0) AS year_before_tx_count
FROM q LEFT JOIN q p ON p.period_index = q.period_index - 1 LEFT JOIN q y ON y.period_index = q.period_index - 4""", r2="volume")
def p2(spark, sf):
    df = reports.periods_of(tables.transactions(spark, sf, "area"), "quarterly")
    return df.select("period_index", "tx_count", "volume", "previous_tx_count", "year_before_tx_count")


@register("p3_period_metrics", TX + f", m AS (SELECT {MEASURES} FROM tx WHERE {IN_Q2}) SELECT *, {DERIVED} FROM m", **ROUND)
def p3(spark, sf):
    return reports.period_metrics(_all(spark, sf), Q2)


@register("p3_period_metrics_of_scope", TX + f""", m AS (SELECT {MEASURES} FROM tx WHERE {IN_Q2} AND area_name_en = 'NATION_7' AND property_type = 'STANDARD')
SELECT *, {DERIVED} FROM m""", **ROUND)
def p3b(spark, sf):
    return reports.period_metrics(_all(spark, sf), Q2, area="NATION_7", property_type="STANDARD")


MIX = """count(*) AS tx_count, sum(actual_worth) AS volume, avg(actual_worth) AS avg_price, avg(meter_sale_price) AS avg_price_sqm,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct"""


@register("p4_type_distribution", TX + f"SELECT property_type, {MIX} FROM tx WHERE {IN_Q2} GROUP BY 1", r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def p4(spark, sf):
    return reports.type_distribution(tables.transactions(spark, sf, "area", "type"), Q2)


def _comparison(other):
    names = reports.COMPARED
    return TX + f""", b AS (SELECT {IN_Q2} AS is_current, {MEASURES} FROM tx WHERE {IN_Q2} OR {other} GROUP BY 1),
d AS (SELECT *, {DERIVED} FROM b),
u AS ({" UNION ALL ".join(f"SELECT '{n}' AS measure, is_current, CAST({n} AS DOUBLE) AS v FROM d" for n in names)}),
p AS (SELECT measure, max(v) FILTER (is_current) AS current_value, max(v) FILTER (NOT is_current) AS previous_value FROM u GROUP BY 1)
SELECT *, current_value - previous_value AS absolute_change,
  CASE WHEN measure <> 'offplan_percentage' THEN (current_value - previous_value) / nullif(previous_value, 0) * 100 END AS percentage_change FROM p"""


@register("p5_comparison_previous", _comparison(IN_Q1), r4="percentage_change", r2="current_value previous_value absolute_change")
def p5(spark, sf):
    return reports.period_comparison(_all(spark, sf), Q2, "mom")


@register("p5_comparison_year_before", _comparison("instance_date >= DATE '1999-04-01' AND instance_date < DATE '1999-07-01'"),
          r4="percentage_change", r2="current_value previous_value absolute_change")
def p5b(spark, sf):
    return reports.period_comparison(_all(spark, sf), Q2, "yoy")


# The first quarter with sales against the one before, and two quarters without any.
FIRST, NEVER = Period(1992, "quarterly", 1), Period(1980, "quarterly", 2)
_ZERO = f"CASE WHEN measure IN {reports.COUNTED} THEN 0.0::DOUBLE END"


def _with_zeros(sql):
    return f"""SELECT measure, coalesce(x.current_value, {_ZERO}) AS current_value, coalesce(x.previous_value, {_ZERO}) AS previous_value,
  coalesce(x.current_value, {_ZERO}) - coalesce(x.previous_value, {_ZERO}) AS absolute_change,
  CASE WHEN measure <> 'offplan_percentage' THEN (coalesce(x.current_value, {_ZERO}) - coalesce(x.previous_value, {_ZERO})) / nullif(coalesce(x.previous_value, {_ZERO}), 0) * 100 END AS percentage_change
FROM (SELECT unnest({list(reports.COMPARED)}) AS measure) LEFT JOIN ({sql}) x USING (measure)"""


def _months(a, b):
    return f"instance_date >= DATE '{a}' AND instance_date < DATE '{b}'"


@register("p5_comparison_with_empty_period", _with_zeros(_comparison(_months("1991-10-01", "1992-01-01")).replace(IN_Q2, _months("1992-01-01", "1992-04-01"))),
          r4="percentage_change", r2="current_value previous_value absolute_change")
def p5c(spark, sf):
    return reports.period_comparison(_all(spark, sf), FIRST, "mom")


@register("p5_comparison_of_empty_periods", _with_zeros(_comparison(_months("1979-04-01", "1979-07-01")).replace(IN_Q2, _months("1980-04-01", "1980-07-01"))),
          r4="percentage_change", r2="current_value previous_value absolute_change")
def p5d(spark, sf):
    return reports.period_comparison(_all(spark, sf), NEVER, "yoy")


def _top(name, metric, limit=10):
    return f"""SELECT {name} AS name, count(*) AS transaction_count, sum(actual_worth) AS sales_volume, avg(actual_worth) AS avg_price,
  avg(meter_sale_price) AS avg_price_sqm, count(*) FILTER (is_luxury) AS luxury_count, count(*) FILTER ({OFF}) AS offplan_count,
  count(DISTINCT project_name_en) AS unique_projects, {MEDIAN} AS median_price, row_number() OVER (ORDER BY {metric} DESC, {name}) AS rank,
  count(*) FILTER (is_luxury) * 100.0::DOUBLE / count(*) AS luxury_percentage, count(*) FILTER ({OFF}) * 100.0::DOUBLE / count(*) AS offplan_percentage
FROM tx WHERE {IN_Q2} AND {name} <> '' GROUP BY 1 HAVING count(*) >= 5 QUALIFY rank <= {limit}"""


TOP_ROUND = {"r6": "avg_price_sqm luxury_percentage offplan_percentage", "r4": "avg_price median_price", "r2": "sales_volume"}


@register("p6_top_areas_by_count", TX + _top("area_name_en", "count(*)"), **TOP_ROUND)
def p6a(spark, sf):
    return reports.top_performers(_all(spark, sf), Q2, "areas", "transaction_count")


@register("p6_top_developers_by_volume", TX + _top("developer", "sum(actual_worth)"), **TOP_ROUND)
def p6b(spark, sf):
    return reports.top_performers(_all(spark, sf), Q2, "developers", "sales_volume")


@register("p6_top_projects_by_price", TX + _top("project_name_en", "avg(actual_worth)"), **TOP_ROUND)
def p6c(spark, sf):
    return reports.top_performers(_all(spark, sf), Q2, "projects", "avg_price")


@register("p6_top_property_types", TX + _top("property_type", "count(*)"), **TOP_ROUND)
def p6d(spark, sf):
    return reports.top_performers(_all(spark, sf), Q2, "property_types")


@register("p7_top_price_growth", TX + f""", g AS (
  SELECT area_name_en AS name, count(*) FILTER ({IN_Q2}) AS current_count, count(*) FILTER ({IN_Q1}) AS previous_count,
    avg(actual_worth) FILTER ({IN_Q2}) AS current_avg_price, avg(actual_worth) FILTER ({IN_Q1}) AS previous_avg_price FROM tx GROUP BY 1),
h AS (SELECT name, current_count, current_avg_price, previous_avg_price, (current_avg_price - previous_avg_price) / previous_avg_price * 100 AS price_growth_pct,
  current_avg_price - previous_avg_price AS price_growth_abs FROM g WHERE current_count >= 5 AND previous_count >= 5)
SELECT *, row_number() OVER (ORDER BY price_growth_pct DESC, name) AS rank FROM h QUALIFY rank <= 10""", r6="price_growth_pct", r4="current_avg_price previous_avg_price price_growth_abs")
def p7(spark, sf):
    return reports.top_price_growth(tables.transactions(spark, sf, "area"), Q2)


@register("p8_area_summaries", TX + f", m AS (SELECT area_name_en, {MEASURES} FROM tx WHERE {IN_Q2} GROUP BY 1) SELECT *, {DERIVED} FROM m", **ROUND)
def p8(spark, sf):
    return reports.area_summaries(_all(spark, sf), Q2)


@register("p8_area_top_projects", TX + f"""
SELECT area_name_en, project_name_en, developer, count(*) AS transaction_count, avg(actual_worth) AS avg_price, avg(meter_sale_price) AS avg_price_sqm,
  count(*) FILTER ({OFF}) AS offplan_count, count(*) FILTER ({OFF}) * 100.0::DOUBLE / count(*) AS offplan_percentage,
  row_number() OVER (PARTITION BY area_name_en ORDER BY count(*) DESC, project_name_en, developer) AS rank
FROM tx WHERE instance_date >= DATE '2000-01-01' AND instance_date < DATE '2001-01-01' GROUP BY 1, 2, 3 HAVING count(*) >= 3 QUALIFY rank <= 10""",
          r6="avg_price avg_price_sqm offplan_percentage")
def p8b(spark, sf):
    return reports.area_top_projects(tables.transactions(spark, sf, "area", "developer", "project"), Period(2000, "annual"))


def _section(section, name):
    return f"""SELECT '{section}' AS section, row_number() OVER (ORDER BY count(*) DESC, {name}) AS rank, {name} AS name, count(*) AS transaction_count,
  sum(actual_worth) AS sales_volume, avg(actual_worth) AS avg_price FROM tx WHERE {IN_Q2} AND {name} <> '' GROUP BY 3 HAVING count(*) >= 5 QUALIFY rank <= 10"""


@register("p9_market_period_overview", TX + " UNION ALL ".join(
    _section(s, n) for s, n in (("areas", "area_name_en"), ("developers", "developer"), ("projects", "project_name_en"))), r4="avg_price", r2="sales_volume")
def p9(spark, sf):
    return reports.market_period_overview(_all(spark, sf), Q2)


@register("p10_time_series", TX + f""", m AS (
  SELECT CAST(year(instance_date) * 12 + month(instance_date) - 1 AS INTEGER) AS period_index, {MEASURES} FROM tx
  WHERE instance_date >= DATE '1994-11-01' AND instance_date < DATE '2000-07-01' GROUP BY 1),
c AS (SELECT CAST(i AS INTEGER) AS period_index FROM range(1994 * 12 + 10, 2000 * 12 + 6) t(i))
SELECT period_index, CAST(period_index // 12 AS INTEGER) AS period_year, CAST(period_index % 12 + 1 AS INTEGER) AS period_number,
  coalesce(total_transactions, 0) AS total_transactions, coalesce(total_sales_volume, 0) AS total_sales_volume, coalesce(luxury_count, 0) AS luxury_count,
  coalesce(offplan_count, 0) AS offplan_count, avg_price, median_price
FROM c LEFT JOIN m USING (period_index)""", r4="avg_price median_price", r2="total_sales_volume")
def p10(spark, sf):
    df = reports.time_series(_all(spark, sf), Period(1994, "monthly", 11), Period(2000, "monthly", 6))
    return df.select(
        "period_index", "period_year", "period_number", "total_transactions", "total_sales_volume", "luxury_count",
        "offplan_count", "avg_price", "median_price",
    )


@register("c8_offplan_report", TX + f""", c AS (
  SELECT count(*) AS total_offplan, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price, min(actual_worth) AS min_price, max(actual_worth) AS max_price,
    sum(actual_worth) AS total_volume, count(DISTINCT area_name_en) AS areas, count(DISTINCT project_name_en) AS projects, count(DISTINCT developer) AS developers,
    avg(meter_sale_price) AS avg_price_sqm, avg(procedure_area) AS avg_size_sqm, count(*) FILTER (is_luxury) AS luxury_offplan FROM tx WHERE {IN_Q2} AND {OFF}),
o AS (SELECT count(*) FILTER ({IN_Q2}) AS market_total, count(*) FILTER ({IN_Q2} AND {RDY}) AS ready_count, avg(actual_worth) FILTER ({IN_Q2} AND {RDY}) AS ready_avg_price,
    count(*) FILTER ({IN_Q1} AND {OFF}) AS previous_offplan, avg(actual_worth) FILTER ({IN_Q1} AND {OFF}) AS previous_avg_price FROM tx)
SELECT *, total_offplan * 100.0::DOUBLE / market_total AS offplan_share, avg_price - ready_avg_price AS gap_to_ready,
  (avg_price - ready_avg_price) / ready_avg_price * 100 AS gap_to_ready_pct, (total_offplan - previous_offplan) * 100.0::DOUBLE / previous_offplan AS transactions_change_pct,
  (avg_price - previous_avg_price) / previous_avg_price * 100 AS price_change_pct FROM c, o""",
          r6="avg_price_sqm avg_size_sqm offplan_share gap_to_ready_pct transactions_change_pct price_change_pct",
          r4="avg_price median_price ready_avg_price previous_avg_price gap_to_ready", r2="total_volume")
def c8(spark, sf):
    return reports.offplan_report(_all(spark, sf), Q2)


def _leaders(condition, sections):
    return " UNION ALL ".join(
        f"""SELECT '{s}' AS section, {n} AS name, count(*) AS transactions, avg(actual_worth) AS avg_price, max(actual_worth) AS max_price,
  sum(actual_worth) AS total_volume, count(DISTINCT project_name_en) AS projects, row_number() OVER (ORDER BY count(*) DESC, {n}) AS rank
FROM tx WHERE {condition} AND {n} <> '' GROUP BY 2 QUALIFY rank <= 10""" for s, n in sections)


SECTIONS = [("areas", "area_name_en"), ("developers", "developer"), ("projects", "project_name_en")]


@register("c8_offplan_leaders", TX + _leaders(f"{IN_Q2} AND {OFF}", SECTIONS), r4="avg_price", r2="total_volume")
def c8b(spark, sf):
    return reports.segment_leaders(_all(spark, sf).where(Q2.contains() & metrics.offplan()))


@register("c9_luxury_report", TX + f""", c AS (
  SELECT count(*) AS total_luxury, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price, min(actual_worth) AS min_price, max(actual_worth) AS max_price,
    sum(actual_worth) AS total_volume, count(DISTINCT area_name_en) AS areas, count(DISTINCT project_name_en) AS projects, count(DISTINCT developer) AS developers,
    avg(meter_sale_price) AS avg_price_sqm, avg(procedure_area) AS avg_size_sqm, count(*) FILTER ({OFF}) AS offplan_luxury FROM tx WHERE {IN_Q2} AND is_luxury),
m AS (SELECT count(*) AS market_total, sum(actual_worth) AS market_volume, count(*) FILTER (actual_worth >= 102000) AS ultra_count,
    avg(actual_worth) FILTER (actual_worth >= 102000) AS ultra_avg_price, max(actual_worth) FILTER (actual_worth >= 102000) AS ultra_max_price FROM tx WHERE {IN_Q2})
SELECT *, total_luxury * 100.0::DOUBLE / market_total AS luxury_share, total_volume * 100 / market_volume AS volume_share FROM c, m""",
          r6="avg_price_sqm avg_size_sqm luxury_share volume_share", r4="avg_price median_price ultra_avg_price", r2="total_volume market_volume")
def c9(spark, sf):
    return reports.luxury_report(_all(spark, sf), Q2, tables.SAMPLE.ultra_luxury_price)


@register("c9_luxury_leaders", TX + _leaders(f"{IN_Q2} AND is_luxury", SECTIONS[:2]), r4="avg_price", r2="total_volume")
def c9b(spark, sf):
    return reports.segment_leaders(_all(spark, sf).where(Q2.contains() & F.col("is_luxury")), ("areas", "developers"))


@register("c10_citation_statistics", TX + f"""
SELECT area_name_en, count(*) AS total_analyzed, CAST(min(instance_date) AS VARCHAR) AS earliest_date, CAST(max(instance_date) AS VARCHAR) AS latest_date,
  count(DISTINCT rooms_en) AS room_types, count(DISTINCT transaction_year) AS years_covered, count(*) FILTER ({OFF}) AS offplan_count,
  count(DISTINCT developer) AS developers_count FROM tx GROUP BY 1""")
def c10(spark, sf):
    df = reports.citation_statistics(tables.transactions(spark, sf, "area", "developer", "rooms"))
    return df.withColumns({c: F.col(c).cast("string") for c in ("earliest_date", "latest_date")})


@register("c11_two_year_comparison", TX + """, b AS (
  SELECT count(*) FILTER (transaction_year = 2000) AS transactions, count(*) FILTER (transaction_year = 1999) AS previous_transactions,
    sum(actual_worth) FILTER (transaction_year = 2000) AS total_value, sum(actual_worth) FILTER (transaction_year = 1999) AS previous_total_value,
    avg(actual_worth) FILTER (transaction_year = 2000) AS avg_price, avg(actual_worth) FILTER (transaction_year = 1999) AS previous_avg_price FROM tx)
SELECT *, (transactions - previous_transactions) * 100.0::DOUBLE / previous_transactions AS transaction_growth_pct,
  (total_value - previous_total_value) / previous_total_value * 100 AS value_growth_pct, (avg_price - previous_avg_price) / previous_avg_price * 100 AS price_growth_pct FROM b""",
          r6="transaction_growth_pct value_growth_pct price_growth_pct", r4="avg_price previous_avg_price", r2="total_value previous_total_value")
def c11a(spark, sf):
    return reports.two_year_comparison(tables.transactions(spark, sf, "area"), 2000)


def _share(name):
    return TX + f"SELECT {name} AS name, {MIX}, row_number() OVER (ORDER BY count(*) DESC, {name}) AS rank FROM tx WHERE transaction_year = 2000 GROUP BY 1 QUALIFY rank <= 20"


@register("c11_top_areas_with_share", _share("area_name_en"), r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def c11b(spark, sf):
    return reports.leaders_with_share(tables.transactions(spark, sf, "area").where("transaction_year = 2000"), "areas")


@register("c11_top_developers_with_share", _share("developer"), r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def c11c(spark, sf):
    return reports.leaders_with_share(tables.transactions(spark, sf, "developer").where("transaction_year = 2000"), "developers")


@register("c11_monthly_totals", TX + """
SELECT transaction_year, transaction_month, count(*) AS tx_count, sum(actual_worth) AS volume, avg(actual_worth) AS avg_price FROM tx
WHERE transaction_year = 2000 GROUP BY 1, 2""", r4="avg_price", r2="volume")
def c11d(spark, sf):
    return reports.monthly_totals(tables.transactions(spark, sf, "area").where("transaction_year = 2000"))


@register("c11_sale_types", TX + f"SELECT transaction_type, {MIX} FROM tx WHERE transaction_year = 2000 GROUP BY 1", r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def c11e(spark, sf):
    df = tables.transactions(spark, sf, "area").where("transaction_year = 2000")
    return metrics.mix(df, "transaction_type", "transaction_type")


BAND_LABELS = ("under 20k", "20k-50k", "50k-80k", "80k-95k", "95k-102k", "102k+")
BAND_CASE = "CASE " + " ".join(
    f"WHEN actual_worth < {int(e)} THEN '{n}'" for e, n in zip(tables.SAMPLE.report_band_edges, BAND_LABELS)) + f" ELSE '{BAND_LABELS[-1]}' END"
BAND_ORDER = "CAST(list_position([" + ", ".join(f"'{n}'" for n in BAND_LABELS) + "], price_band) AS INTEGER) AS band_order"


@register("c11_price_segments", TX + f"SELECT *, {BAND_ORDER} FROM (SELECT {BAND_CASE} AS price_band, {MIX} FROM tx WHERE transaction_year = 2000 GROUP BY 1)",
          r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def c11f(spark, sf):
    df = tables.transactions(spark, sf, "area").where("transaction_year = 2000")
    return reports.price_bands(df, tables.SAMPLE.report_band_edges, BAND_LABELS)


SEG = f"transaction_year = 2000 AND property_type = 'MEDIUM' AND {OFF}"


def _segment(spark, sf):
    return tables.transactions(spark, sf).where("transaction_year = 2000 AND property_type = 'MEDIUM' AND transaction_type = 'Off-Plan'")


@register("c12_drill_down", TX + f""", c AS (
  SELECT count(*) AS tx_count, sum(actual_worth) AS total_value, avg(actual_worth) AS avg_price, avg(procedure_area) * 10.764 AS avg_size_sqft,
    avg(meter_sale_price) / 10.764 AS avg_price_per_sqft, {MEDIAN} AS median_price FROM tx WHERE {SEG}),
m AS (SELECT count(*) FILTER ({OFF}) AS sale_type_count, sum(actual_worth) FILTER ({OFF}) AS sale_type_value,
    avg(actual_worth) FILTER (property_type = 'MEDIUM' AND {RDY}) AS ready_avg_price, avg(actual_worth) FILTER (property_type <> 'MEDIUM' AND {OFF}) AS other_types_avg_price
  FROM tx WHERE transaction_year = 2000)
SELECT *, tx_count * 100.0::DOUBLE / sale_type_count AS share_of_sale_type, total_value * 100 / sale_type_value AS value_share,
  (ready_avg_price - avg_price) / ready_avg_price * 100 AS discount_to_ready_pct, (avg_price - other_types_avg_price) / other_types_avg_price * 100 AS premium_to_other_types_pct
FROM c, m""", r6="avg_size_sqft avg_price_per_sqft share_of_sale_type value_share discount_to_ready_pct premium_to_other_types_pct",
          r4="avg_price median_price ready_avg_price other_types_avg_price", r2="total_value sale_type_value")
def c12(spark, sf):
    return reports.drill_down(tables.transactions(spark, sf, "type"), "MEDIUM", "Off-Plan", 2000)


@register("c12_segment_leaders", TX + _leaders(SEG, SECTIONS), r4="avg_price", r2="total_volume")
def c12b(spark, sf):
    return reports.segment_leaders(_segment(spark, sf))


@register("c12_rooms_breakdown", TX + f"""
SELECT rooms_en, count(*) AS tx_count, avg(actual_worth) AS avg_price, avg(procedure_area) * 10.764 AS avg_size_sqft, avg(meter_sale_price) / 10.764 AS avg_price_per_sqft,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct, CAST(CAST(rooms_en[1] AS INTEGER) * 2 AS INTEGER) AS room_order FROM tx WHERE {SEG} GROUP BY 1""",
          r6="avg_size_sqft avg_price_per_sqft pct", r4="avg_price")
def c12c(spark, sf):
    return reports.rooms_breakdown(_segment(spark, sf))


@register("c12_price_bands", TX + f"SELECT *, {BAND_ORDER} FROM (SELECT {BAND_CASE} AS price_band, {MIX} FROM tx WHERE {SEG} GROUP BY 1)",
          r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def c12d(spark, sf):
    return reports.price_bands(_segment(spark, sf), tables.SAMPLE.report_band_edges, BAND_LABELS)


@register("c12_monthly", TX + f"""SELECT transaction_year, transaction_month, count(*) AS tx_count, sum(actual_worth) AS volume, avg(actual_worth) AS avg_price
FROM tx WHERE {SEG} GROUP BY 1, 2""", r4="avg_price", r2="volume")
def c12e(spark, sf):
    return reports.monthly_totals(_segment(spark, sf))


@register("c13_developer_reports", TX + f""", d AS ({M12}), pr AS (
  SELECT developer, project_name_en, area_name_en, transaction_type, count(*) AS project_tx_count, avg(actual_worth) AS project_avg_price,
    row_number() OVER (PARTITION BY developer ORDER BY count(*) DESC, project_name_en, area_name_en, transaction_type) AS project_rank
  FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5 QUALIFY project_rank <= 10)
SELECT d.*, coalesce(project_rank, 0) AS project_rank, project_name_en, area_name_en, transaction_type, coalesce(project_tx_count, 0) AS project_tx_count, project_avg_price
FROM d LEFT JOIN pr USING (developer)""", r6="project_avg_price", r4="avg_price median_price", r2="total_sales_volume")
def c13(spark, sf):
    df = shared(tables.transactions(spark, sf))
    out = reports.developer_reports(metrics.developer_metrics(df), metrics.project_metrics(df))
    return out.fillna(0, subset=["project_rank", "project_tx_count"]).withColumns(
        {c: F.col(c).cast("string") for c in ("first_sale_date", "last_sale_date")}
    )


SERIES = "count(*) AS transaction_count, sum(actual_worth) AS total_volume, avg(actual_worth) AS avg_price"
SERIES_ROUND = {"r4": "avg_price", "r2": "total_volume"}


@register("d1_monthly_trend", TX + f"SELECT transaction_month, {SERIES} FROM tx WHERE transaction_year = 2000 GROUP BY 1", **SERIES_ROUND)
def d1(spark, sf):
    return charts.monthly_trend(tables.transactions(spark, sf, "area"), 2000)


@register("d1_monthly_trend_luxury", TX + f"SELECT transaction_month, {SERIES} FROM tx WHERE transaction_year = 2000 AND is_luxury GROUP BY 1", **SERIES_ROUND)
def d1b(spark, sf):
    return charts.monthly_trend(tables.transactions(spark, sf, "area"), 2000, "luxury")


@register("d2_quarter_against_previous", TX + f"""
SELECT CASE WHEN {IN_Q1} THEN 'Q1 2000' ELSE 'Q4 1999' END AS quarter_label, transaction_month, {SERIES} FROM tx
WHERE instance_date >= DATE '1999-10-01' AND instance_date < DATE '2000-04-01' GROUP BY 1, 2""", **SERIES_ROUND)
def d2(spark, sf):
    return charts.quarter_against_previous(tables.transactions(spark, sf, "area"), 2000, 1)


@register("d3_top_areas", TX + f"SELECT area_name_en AS name, {SERIES}, row_number() OVER (ORDER BY count(*) DESC, area_name_en) AS rank FROM tx WHERE {IN_Q2} GROUP BY 1 QUALIFY rank <= 10", **SERIES_ROUND)
def d3(spark, sf):
    return charts.top_names(tables.transactions(spark, sf, "area"), "area_name_en", year=2000, quarter=2)


@register("d4_top_developers", TX + f"SELECT developer AS name, {SERIES}, row_number() OVER (ORDER BY sum(actual_worth) DESC, developer) AS rank FROM tx WHERE transaction_year = 2000 AND {OFF} GROUP BY 1 QUALIFY rank <= 10", **SERIES_ROUND)
def d4(spark, sf):
    return charts.top_names(tables.transactions(spark, sf, "developer"), "developer", "total_volume", year=2000, segment="offplan")


@register("d5_sale_type_mix", TX + "SELECT transaction_type AS segment, count(*) AS tx_count FROM tx WHERE transaction_year = 2000 GROUP BY 1")
def d5a(spark, sf):
    return charts.segment_mix(charts.in_period(tables.transactions(spark, sf, "area"), 2000), F.col("transaction_type"))


@register("d5_price_tier_mix", TX + """SELECT CASE WHEN actual_worth < 50000 THEN 'Standard' WHEN actual_worth < 95000 THEN 'Mid-Range'
  WHEN actual_worth < 102000 THEN 'Luxury' ELSE 'Ultra Luxury' END AS segment, count(*) AS tx_count FROM tx WHERE transaction_year = 2000 GROUP BY 1""")
def d5b(spark, sf):
    df = charts.in_period(tables.transactions(spark, sf, "area"), 2000)
    return charts.segment_mix(df, charts.price_tier(tables.SAMPLE.band_edges))


@register("d5_property_type_mix", TX + "SELECT property_type AS segment, count(*) AS tx_count FROM tx WHERE transaction_year = 2000 GROUP BY 1")
def d5c(spark, sf):
    return charts.segment_mix(charts.in_period(tables.transactions(spark, sf, "type"), 2000), F.col("property_type"))


@register("d6_price_histogram", TX + """, s AS (SELECT actual_worth AS p FROM tx WHERE transaction_year = 2000), e AS (SELECT min(p) AS lo, max(p) AS hi FROM s),
n AS (SELECT CAST(least(floor((p - lo) / (hi - lo) * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS c FROM s, e GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, lo + (hi - lo) / 10 * (b - 1) AS bin_from, lo + (hi - lo) / 10 * b AS bin_to, coalesce(c, 0) AS tx_count
FROM e, range(1, 11) t(b) LEFT JOIN n ON n.bin = b""", r6="bin_from bin_to")
def d6(spark, sf):
    return charts.price_histogram(charts.in_period(tables.transactions(spark, sf, "area"), 2000))


@register("d7_two_year_overlay", TX + """SELECT transaction_year, transaction_month, count(*) AS tx_count, sum(actual_worth) AS volume, count(*) FILTER (is_luxury) AS luxury_count
FROM tx WHERE transaction_year IN (1999, 2000) GROUP BY 1, 2""", r2="volume")
def d7(spark, sf):
    return charts.two_year_overlay(tables.transactions(spark, sf, "area"), (1999, 2000))


@register("d8_area_matrix", TX + """SELECT area_name_en, count(*) AS tx_count, avg(actual_worth) AS avg_price, sum(actual_worth) AS total_value,
  count(*) FILTER (transaction_type LIKE '%Off%') AS offplan_count, count(*) FILTER (transaction_type LIKE '%Off%') * 100.0::DOUBLE / count(*) AS offplan_pct
FROM tx GROUP BY 1 HAVING count(*) >= 1000""", r6="offplan_pct", r4="avg_price", r2="total_value")
def d8(spark, sf):
    return charts.area_matrix(tables.transactions(spark, sf, "area"))


@register("d9_quarterly_prices", TX + "SELECT CAST(CAST(date_trunc('quarter', instance_date) AS DATE) AS VARCHAR) AS quarter, avg(actual_worth) AS avg_price, count(*) AS tx_count FROM tx GROUP BY 1", r4="avg_price")
def d9(spark, sf):
    df = charts.quarterly_prices(tables.transactions(spark, sf, "area"))
    return df.withColumn("quarter", F.col("quarter").cast("string"))


@register("d10_offplan_by_month", TX + """SELECT transaction_year, transaction_month, count(*) FILTER (transaction_type LIKE '%Off%') AS offplan_count,
  count(*) FILTER (transaction_type NOT LIKE '%Off%') AS ready_count FROM tx GROUP BY 1, 2""")
def d10(spark, sf):
    return charts.offplan_by_month(tables.transactions(spark, sf, "area"))


@register("d11_series_facts", TX + """, s AS (SELECT area_name_en, transaction_month AS m, count(*) AS v FROM tx WHERE transaction_year = 2000 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY area_name_en ORDER BY v DESC, m) AS place FROM s),
f AS (SELECT area_name_en, arg_min(v, m) AS first_value, arg_max(v, m) AS last_value, max(m) FILTER (place = 1) AS peak_label, max(v) AS peak_value,
  max(v) FILTER (place = 2) AS second_value, CAST(sum(v) AS BIGINT) AS total_value FROM r GROUP BY 1)
SELECT *, (last_value - first_value) * 100.0::DOUBLE / first_value AS overall_change_pct, (peak_value - second_value) * 100.0::DOUBLE / second_value AS lead_margin_pct,
  peak_value * 100.0::DOUBLE / total_value AS dominant_share_pct FROM f""", r6="overall_change_pct lead_margin_pct dominant_share_pct")
def d11(spark, sf):
    df = charts.in_period(tables.transactions(spark, sf, "area"), 2000)
    series = df.groupBy("area_name_en", "transaction_month").agg(F.count(F.lit(1)).alias("tx_count"))
    return charts.series_facts(series, ["area_name_en"], "transaction_month", "transaction_month", "tx_count")
