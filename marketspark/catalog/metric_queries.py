"""Registered queries: metric tables and the window derivations on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import TX, register
from marketspark.config import SEGMENTS
from marketspark.functions.lineage import shared
from marketspark.operators import metrics
from marketspark.sources import driver_tables as tables

MEDIAN = "quantile_cont(actual_worth, 0.5)"


def _texts(df, *names):
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def _public(spark, sf):
    """Sales under the column names of the public feed; ship modes stand in for metros and malls."""
    df = tables.transactions(spark, sf)
    metro = F.concat(F.lit("Metro "), F.substring("rooms_en", 1, 1))
    return df.withColumnsRenamed(
        {"property_type": "property_type_en", "transaction_type": "reg_type_en", "developer": "master_project_en"}
    ).withColumns(
        {
            "trans_group_en": F.when(F.col("originally_offplan"), "Sales").otherwise("Mortgages"),
            "nearest_metro_en": metro,
            "nearest_mall_en": F.concat(F.lit("Mall "), F.substring("property_type_en", 1, 1)),
        }
    )


PUB = TX + """, pub AS (SELECT *, property_type AS property_type_en, transaction_type AS reg_type_en, developer AS master_project_en,
  'Metro ' || substr(rooms_en, 1, 1) AS metro, 'Mall ' || substr(property_type, 1, 1) AS mall
  FROM tx WHERE originally_offplan AND transaction_year >= 1999)"""

M1 = f"""SELECT area_name_en, count(*) AS total_transactions, count(DISTINCT property_type) AS property_types,
  count(DISTINCT project_name_en) AS unique_projects, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price,
  min(actual_worth) AS min_price, max(actual_worth) AS max_price, avg(meter_sale_price) AS avg_price_sqm,
  avg(procedure_area) AS avg_size_sqm, count(*) FILTER (is_luxury) AS luxury_count,
  count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_count, max(transaction_year) AS last_transaction_year,
  array_to_string(list_sort(list(DISTINCT developer)), ', ') AS top_developers
FROM tx GROUP BY 1 HAVING count(*) >= 10"""


@register("m1_area_metrics", TX + M1, r6="avg_price avg_price_sqm avg_size_sqm median_price")
def m1(spark, sf):
    return metrics.area_metrics(tables.transactions(spark, sf, "area", "developer", "project", "type"))


@register("m2_area_metrics_public", PUB + f"""
SELECT area_name_en, count(*) AS total_transactions, count(DISTINCT property_type_en) AS property_types, avg(actual_worth) AS avg_price,
  {MEDIAN} AS median_price, min(actual_worth) AS min_price, max(actual_worth) AS max_price, avg(meter_sale_price) AS avg_price_sqm,
  avg(procedure_area) AS avg_size_sqm, count(*) FILTER (is_luxury) AS luxury_count, max(transaction_year) AS last_transaction_year,
  array_to_string(list_sort(list(DISTINCT metro)), ', ') AS nearby_metros, array_to_string(list_sort(list(DISTINCT mall)), ', ') AS nearby_malls
FROM pub GROUP BY 1 HAVING count(*) >= 10""", r6="avg_price avg_price_sqm avg_size_sqm median_price")
def m2(spark, sf):
    return metrics.area_metrics_public(_public(spark, sf), from_year=1999)


M3_COLUMNS = f"""area_name_en, transaction_year, transaction_month, property_type, count(*) AS tx_count, avg(actual_worth) AS avg_price,
  {MEDIAN} AS median_price, avg(meter_sale_price) AS avg_price_sqm, count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_count"""
M3 = f"SELECT {M3_COLUMNS} FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3"
M3_CTE = TX + f", m3 AS ({M3})"


def trends(spark, sf):
    return metrics.monthly_trends(shared(tables.transactions(spark, sf, "area", "type")))


@register("m3_monthly_trends", TX + M3, r6="avg_price median_price avg_price_sqm")
def m3(spark, sf):
    return trends(spark, sf)


@register("m3_monthly_trend_ids", M3_CTE + """
SELECT area_name_en, transaction_year, transaction_month, property_type, transaction_id,
  row_number() OVER (PARTITION BY area_name_en, transaction_year, transaction_month, property_type ORDER BY actual_worth DESC, transaction_id) AS position
FROM tx SEMI JOIN m3 USING (area_name_en, transaction_year, transaction_month, property_type)""")
def m3_ids(spark, sf):
    df = tables.transactions(spark, sf, "area", "type")
    return metrics.monthly_members(df, metrics.monthly_trends(df)).drop("actual_worth")


@register("m4_monthly_trends_public", PUB + """
SELECT area_name_en, transaction_year, transaction_month, property_type_en, count(*) AS tx_count, avg(actual_worth) AS avg_price,
  avg(meter_sale_price) AS avg_price_sqm FROM pub GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""", r6="avg_price avg_price_sqm")
def m4(spark, sf):
    df = _public(spark, sf).where((F.col("trans_group_en") == "Sales") & (F.col("transaction_year") >= 1999))
    return metrics.monthly_trends(
        df, with_median=False, keys=("area_name_en", "transaction_year", "transaction_month", "property_type_en")
    )


@register("m5_property_type_metrics", TX + f"""
SELECT area_name_en, property_type, rooms_en, count(*) AS tx_count, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price,
  avg(meter_sale_price) AS avg_price_sqm, avg(procedure_area) AS avg_size_sqm, quantile_cont(actual_worth, 0.25) AS price_q1,
  quantile_cont(actual_worth, 0.75) AS price_q3, min(actual_worth) AS min_price, max(actual_worth) AS max_price
FROM tx GROUP BY 1, 2, 3 HAVING count(*) >= 5""", r6="avg_price avg_price_sqm avg_size_sqm", r4="median_price price_q1 price_q3")
def m5(spark, sf):
    return metrics.property_type_metrics(tables.transactions(spark, sf, "area", "type", "rooms"))


@register("m6_property_type_metrics_public", PUB + """
SELECT area_name_en, property_type_en, rooms_en, count(*) AS tx_count, avg(actual_worth) AS avg_price, avg(meter_sale_price) AS avg_price_sqm,
  avg(procedure_area) AS avg_size_sqm, quantile_cont(actual_worth, 0.25) AS price_q1, quantile_cont(actual_worth, 0.75) AS price_q3
FROM pub WHERE property_type_en = 'STANDARD' GROUP BY 1, 2, 3 HAVING count(*) >= 5""", r6="avg_price avg_price_sqm avg_size_sqm", r4="price_q1 price_q3")
def m6(spark, sf):
    return metrics.property_type_metrics_public(_public(spark, sf), kind="STANDARD", from_year=1999)


@register("m7_luxury_monthly", TX + f"""
SELECT area_name_en, transaction_year, transaction_month, count(*) AS luxury_tx_count, avg(actual_worth) AS avg_luxury_price,
  {MEDIAN} AS median_luxury_price, min(actual_worth) AS min_luxury_price, max(actual_worth) AS max_luxury_price,
  array_to_string(list_sort(list(DISTINCT project_name_en)), ', ') AS luxury_projects, array_to_string(list_sort(list(DISTINCT developer)), ', ') AS luxury_developers
FROM tx WHERE is_luxury GROUP BY 1, 2, 3 HAVING count(*) >= 3""", r6="avg_luxury_price median_luxury_price")
def m7(spark, sf):
    return metrics.luxury_monthly(shared(tables.transactions(spark, sf, "area", "developer", "project")))


@register("m8_luxury_yearly", TX + """
SELECT area_name_en, transaction_year, count(*) AS luxury_tx_count, avg(actual_worth) AS avg_luxury_price, min(actual_worth) AS min_luxury_price,
  max(actual_worth) AS max_luxury_price, array_to_string(list_sort(list(DISTINCT project_name_en)), ', ') AS luxury_projects
FROM tx WHERE is_luxury AND transaction_year >= 1998 GROUP BY 1, 2 HAVING count(*) >= 3""", r6="avg_luxury_price")
def m8(spark, sf):
    return metrics.luxury_yearly(tables.transactions(spark, sf, "area", "project"), from_year=1998)


@register("m9_luxury_summary", TX + """
SELECT area_name_en, count(*) AS total_luxury_transactions, avg(actual_worth) AS avg_luxury_price, max(actual_worth) AS highest_sale,
  avg(meter_sale_price) AS avg_price_sqm, count(DISTINCT project_name_en) AS luxury_projects_count, count(DISTINCT developer) AS luxury_developers_count
FROM tx WHERE is_luxury GROUP BY 1 HAVING count(*) >= 5""", r6="avg_luxury_price avg_price_sqm")
def m9(spark, sf):
    return metrics.luxury_summary(tables.transactions(spark, sf, "area", "developer", "project"))


@register("m10_project_metrics", TX + f"""
SELECT project_name_en, developer, area_name_en, transaction_type, count(*) AS tx_count, avg(actual_worth) AS avg_price, {MEDIAN} AS median_price,
  avg(meter_sale_price) AS avg_price_sqm, CAST(min(instance_date) AS VARCHAR) AS first_sale_date, CAST(max(instance_date) AS VARCHAR) AS last_sale_date,
  count(*) FILTER (is_luxury) AS luxury_units, array_to_string(list_sort(list(DISTINCT rooms_en)), ', ') AS unit_types_available
FROM tx WHERE project_name_en IS NOT NULL AND project_name_en <> '' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""", r6="avg_price median_price avg_price_sqm")
def m10(spark, sf):
    return _texts(metrics.project_metrics(shared(tables.transactions(spark, sf))), "first_sale_date", "last_sale_date")


@register("m11_project_metrics_public", PUB + """
SELECT project_name_en, master_project_en, area_name_en, reg_type_en, count(*) AS tx_count, avg(actual_worth) AS avg_price,
  min(transaction_year) AS first_sale_year, max(transaction_year) AS last_sale_year, count(*) FILTER (is_luxury) AS luxury_units
FROM pub WHERE project_name_en <> 'Not Applicable' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""", r6="avg_price")
def m11(spark, sf):
    return metrics.project_metrics_public(_public(spark, sf), from_year=1999)


M12 = f"""SELECT developer, count(*) AS total_transactions, count(DISTINCT area_name_en) AS areas_active, count(DISTINCT project_name_en) AS projects_count,
  avg(actual_worth) AS avg_price, {MEDIAN} AS median_price, sum(actual_worth) AS total_sales_volume, count(*) FILTER (is_luxury) AS luxury_units,
  count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_sales, CAST(min(instance_date) AS VARCHAR) AS first_sale_date,
  CAST(max(instance_date) AS VARCHAR) AS last_sale_date
FROM tx WHERE developer <> '' GROUP BY 1 HAVING count(*) >= 10"""


@register("m12_developer_metrics", TX + M12, r6="avg_price median_price", r2="total_sales_volume")
def m12(spark, sf):
    df = metrics.developer_metrics(shared(tables.transactions(spark, sf, "area", "developer", "project")))
    return _texts(df, "first_sale_date", "last_sale_date")


@register("m13_offplan_monthly", TX + f"""
SELECT area_name_en, transaction_year, transaction_month, transaction_type, count(*) AS tx_count, avg(actual_worth) AS avg_price,
  {MEDIAN} AS median_price, avg(meter_sale_price) AS avg_price_sqm FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""", r6="avg_price median_price avg_price_sqm")
def m13(spark, sf):
    return metrics.offplan_monthly(shared(tables.transactions(spark, sf, "area")))


@register("m14_offplan_comparison", TX + """
SELECT area_name_en, count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_count, count(*) FILTER (transaction_type = 'Existing') AS ready_count,
  avg(actual_worth) FILTER (transaction_type = 'Off-Plan') AS avg_offplan_price, avg(actual_worth) FILTER (transaction_type = 'Existing') AS avg_ready_price,
  count(*) FILTER (transaction_type = 'Off-Plan') * 100.0::DOUBLE / count(*) AS offplan_percentage
FROM tx GROUP BY 1 HAVING count(*) >= 20""", r6="avg_offplan_price avg_ready_price offplan_percentage")
def m14(spark, sf):
    return metrics.offplan_comparison(tables.transactions(spark, sf, "area"))


@register("m15_market_overview", TX + f"""
SELECT count(*) AS total_transactions, count(DISTINCT area_name_en) AS unique_areas, count(DISTINCT project_name_en) AS unique_projects,
  count(DISTINCT developer) AS unique_developers, CAST(min(instance_date) AS VARCHAR) AS earliest_date, CAST(max(instance_date) AS VARCHAR) AS latest_date,
  avg(actual_worth) AS avg_price, {MEDIAN} AS median_price, sum(actual_worth) AS total_market_volume, count(*) FILTER (is_luxury) AS luxury_count,
  count(*) FILTER (transaction_type = 'Off-Plan') AS offplan_count FROM tx""", r4="avg_price median_price", r2="total_market_volume")
def m15(spark, sf):
    df = metrics.market_overview(tables.transactions(spark, sf, "area", "developer", "project"))
    return _texts(df, "earliest_date", "latest_date")


ROLLUP = """CAST(sum(tx_count) AS BIGINT) AS tx_count, avg(avg_price) AS avg_price, avg(avg_price_sqm) AS avg_price_sqm,
  sum(avg_price * tx_count) / sum(tx_count) AS weighted_avg_price"""
R16 = "avg_price avg_price_sqm weighted_avg_price"


@register("m16_rollup_area_month", M3_CTE + f"SELECT area_name_en, transaction_month, {ROLLUP} FROM m3 WHERE transaction_year = 2000 GROUP BY 1, 2", r6=R16)
def m16a(spark, sf):
    return metrics.trend_rollup(trends(spark, sf), ["area_name_en", "transaction_month"], year=2000)


@register("m16_rollup_month", M3_CTE + f"SELECT transaction_month, {ROLLUP} FROM m3 WHERE transaction_year = 2000 AND property_type = 'STANDARD' GROUP BY 1", r6=R16)
def m16b(spark, sf):
    return metrics.trend_rollup(trends(spark, sf), ["transaction_month"], year=2000, property_type="STANDARD")


@register("m16_rollup_year", M3_CTE + f"SELECT transaction_year, {ROLLUP} FROM m3 GROUP BY 1", r6=R16)
def m16c(spark, sf):
    return metrics.trend_rollup(trends(spark, sf), ["transaction_year"])


@register("m16_month_snapshot", M3_CTE + """, lux AS (SELECT area_name_en FROM tx WHERE is_luxury GROUP BY 1 HAVING count(*) >= 120)
SELECT CAST(sum(tx_count) AS BIGINT) AS tx_count, count(DISTINCT area_name_en) AS areas, avg(avg_price) AS avg_price,
  CAST(coalesce(sum(tx_count) FILTER (area_name_en IN (SELECT area_name_en FROM lux)), 0) AS BIGINT) AS luxury_area_tx
FROM m3 WHERE transaction_year = 2000 AND transaction_month = 6""", r6="avg_price")
def m16d(spark, sf):
    df = tables.transactions(spark, sf, "area", "type")
    luxury_areas = df.where("is_luxury").groupBy("area_name_en").agg(F.count(F.lit(1)).alias("n")).where("n >= 120")
    return metrics.month_snapshot(metrics.monthly_trends(df), luxury_areas, 2000, 6)


@register("m16_top_areas_of_month", M3_CTE + """
SELECT area_name_en, CAST(sum(tx_count) AS BIGINT) AS tx_count, avg(avg_price) AS avg_price FROM m3
WHERE transaction_year = 2000 AND transaction_month = 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", r6="avg_price")
def m16e(spark, sf):
    return metrics.top_areas_of_month(trends(spark, sf), 2000, 6)


W1 = """SELECT area_name_en, transaction_year, transaction_month, property_type, avg_price, tx_count, lag(avg_price) OVER w AS prev_month_price,
  coalesce(lag(tx_count) OVER w, -1) AS prev_month_tx_count, (avg_price - lag(avg_price) OVER w) / nullif(lag(avg_price) OVER w, 0) * 100 AS pct_change_mom
FROM m3 WINDOW w AS (PARTITION BY area_name_en, property_type ORDER BY transaction_year, transaction_month)"""


@register("w1_month_over_month", M3_CTE + W1, r6="avg_price prev_month_price pct_change_mom")
def w1(spark, sf):
    df = metrics.month_over_month(trends(spark, sf))
    return df.withColumn("prev_month_tx_count", F.coalesce("prev_month_tx_count", F.lit(-1)))


@register("w2_month_over_month_public", PUB + """, m4 AS (
  SELECT area_name_en, transaction_year, transaction_month, property_type_en, avg(actual_worth) AS avg_price FROM pub GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)
SELECT *, lag(avg_price) OVER w AS prev_month_price, (avg_price - lag(avg_price) OVER w) / lag(avg_price) OVER w * 100 AS pct_change_mom
FROM m4 WINDOW w AS (PARTITION BY area_name_en, property_type_en ORDER BY transaction_year, transaction_month)""", r6="avg_price prev_month_price pct_change_mom")
def w2(spark, sf):
    df = m4(spark, sf).withColumnRenamed("property_type_en", "property_type")
    out = metrics.month_over_month(df).drop("tx_count", "prev_month_tx_count")
    return out.withColumnRenamed("property_type", "property_type_en")


@register("w3_year_over_year", M3_CTE + """, y AS (
  SELECT area_name_en, transaction_year, property_type, CAST(sum(tx_count) AS BIGINT) AS total_transactions, avg(avg_price) AS avg_price, avg(avg_price_sqm) AS avg_price_sqm
  FROM m3 GROUP BY 1, 2, 3)
SELECT *, coalesce(lag(total_transactions) OVER w, -1) AS prev_year_transactions, lag(avg_price) OVER w AS prev_year_price
FROM y WINDOW w AS (PARTITION BY area_name_en, property_type ORDER BY transaction_year)""", r6="avg_price avg_price_sqm prev_year_price")
def w3(spark, sf):
    df = metrics.year_over_year(trends(spark, sf))
    return df.withColumn("prev_year_transactions", F.coalesce("prev_year_transactions", F.lit(-1)))


@register("w4_share_of_total", TX + """
SELECT property_type, count(*) AS tx_count, sum(actual_worth) AS volume, avg(actual_worth) AS avg_price, avg(meter_sale_price) AS avg_price_sqm,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM tx GROUP BY 1""", r6="avg_price_sqm pct", r4="avg_price", r2="volume")
def w4(spark, sf):
    return metrics.mix(tables.transactions(spark, sf, "type"), "property_type", "property_type")


@register("w4_share_within_area", TX + """
SELECT area_name_en, rooms_en, count(*) AS tx_count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY area_name_en) AS pct
FROM tx GROUP BY 1, 2""", r6="pct")
def w4b(spark, sf):
    return metrics.mix_within(tables.transactions(spark, sf, "area", "rooms"), "area_name_en", "rooms_en", "rooms_en")


BAND = "CASE WHEN actual_worth < 50000 THEN 'affordable' WHEN actual_worth < 95000 THEN 'mid_range' WHEN actual_worth < 102000 THEN 'luxury' ELSE 'ultra_luxury' END"
BANDS = ("affordable", "mid_range", "luxury", "ultra_luxury")


def _band_sql(also, keep):
    return TX + f""", b AS (SELECT *, {BAND} AS price_category FROM tx),
r AS (SELECT *, row_number() OVER (PARTITION BY area_name_en, price_category{also} ORDER BY actual_worth DESC, transaction_id) AS band_rank FROM b)
SELECT area_name_en, transaction_id, rooms_en, actual_worth, price_category, band_rank,
  row_number() OVER (PARTITION BY area_name_en ORDER BY actual_worth DESC, transaction_id) AS area_rank
FROM r WHERE band_rank <= {keep} QUALIFY area_rank <= 8"""


SAMPLE_COLUMNS = ("area_name_en", "transaction_id", "rooms_en", "actual_worth", "price_category", "band_rank", "area_rank")


@register("w5_band_samples", _band_sql("", 2))
def w5(spark, sf):
    df = tables.transactions(spark, sf, "area", "rooms")
    return metrics.band_samples(df, tables.SAMPLE.band_edges, BANDS).select(*SAMPLE_COLUMNS)


@register("w6_band_room_samples", _band_sql(", rooms_en", 1))
def w6(spark, sf):
    df = tables.transactions(spark, sf, "area", "rooms")
    return metrics.band_samples(df, tables.SAMPLE.band_edges, BANDS, also_by=("rooms_en",), per_group=1).select(*SAMPLE_COLUMNS)


@register("w8_rank_numbering", TX + """
SELECT *, row_number() OVER (ORDER BY actual_worth DESC, transaction_id) AS rank FROM (
  SELECT transaction_id, area_name_en, actual_worth FROM tx ORDER BY actual_worth DESC, transaction_id LIMIT 25)""")
def w8(spark, sf):
    order = (F.desc("actual_worth"), F.col("transaction_id"))
    top = tables.transactions(spark, sf, "area").orderBy(*order).limit(25).select("transaction_id", "area_name_en", "actual_worth")
    return metrics.numbered(top, *order)
