"""Registered queries: anomalies, opportunities, trends, profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketspark.catalog.registry import TX, register
from marketspark.catalog.report_queries import IN_Q1, IN_Q2, OFF, Q2
from marketspark.functions.periods import Period
from marketspark.operators import anomalies, opportunities, profiles, trends
from marketspark.operators.metrics import area_metrics
from marketspark.sources import driver_tables as tables

JUNE, YEAR = Period(2000, "monthly", 6), Period(2000, "annual")
IN_JUNE = "instance_date >= DATE '2000-06-01' AND instance_date < DATE '2000-07-01'"
BEFORE_JUNE = "instance_date >= DATE '1999-06-01' AND instance_date < DATE '2000-06-01'"
IN_YEAR = "instance_date >= DATE '2000-01-01' AND instance_date < DATE '2001-01-01'"
# The window of equal length in days before the second quarter of 2000.
BEFORE_Q2 = "instance_date >= DATE '2000-01-01' AND instance_date < DATE '2000-04-01'"
EDGES = tables.SAMPLE.segment_edges
AS_OF, SEASON_START = date(2000, 11, 30), date(1998, 1, 1)


def _text(df, *names):
    return df.withColumns({c: F.col(c).cast("string") for c in names})


RECORD_COLUMNS = ("transaction_id", "area_name_en", "property_type", "actual_worth", "rank")


def _records(condition, limit):
    return TX + f"""SELECT transaction_id, area_name_en, property_type, actual_worth, row_number() OVER (ORDER BY actual_worth DESC, transaction_id) AS rank
FROM tx WHERE {condition} QUALIFY rank <= {limit}"""


@register("a1_record_sales", _records(IN_Q2, 10))
def a1(spark, sf):
    return anomalies.record_sales(tables.transactions(spark, sf, "area", "type"), Q2).select(*RECORD_COLUMNS)


@register("a2_ultra_luxury_records", _records(f"{IN_Q2} AND actual_worth >= 102000", 5))
def a2(spark, sf):
    df = tables.transactions(spark, sf, "area", "type")
    return anomalies.ultra_luxury_records(df, Q2, min_price=tables.SAMPLE.ultra_luxury_price).select(*RECORD_COLUMNS)


def _shift(key, now, before, months, per=1):
    return f""", g AS (SELECT {key}, count(*) FILTER ({now}) AS current_count, coalesce(sum(actual_worth) FILTER ({now}), 0) AS current_value,
  count(*) FILTER ({before}) / {months}.0::DOUBLE AS historical_monthly_avg FROM tx GROUP BY 1),
s AS (SELECT *, (current_count / {per}.0::DOUBLE - historical_monthly_avg) / nullif(historical_monthly_avg, 0) * 100 AS change_pct FROM g)"""


SHIFT_ROUND = {"r6": "historical_monthly_avg change_pct", "r2": "current_value"}


@register("a3_volume_spikes", TX + _shift("area_name_en", IN_JUNE, BEFORE_JUNE, 12) + """
SELECT * FROM s WHERE historical_monthly_avg > 5 AND current_count > 0 AND change_pct >= 15 ORDER BY change_pct DESC, area_name_en LIMIT 10""", **SHIFT_ROUND)
def a3(spark, sf):
    return anomalies.volume_spikes(tables.transactions(spark, sf, "area"), JUNE, threshold=15.0)


@register("a3_volume_spikes_whole_period", TX + _shift("area_name_en", IN_Q2, "instance_date >= DATE '1999-04-01' AND instance_date < DATE '2000-04-01'", 12) + """
SELECT * FROM s WHERE historical_monthly_avg > 5 AND current_count > 0 AND change_pct >= 30 ORDER BY change_pct DESC, area_name_en LIMIT 10""", **SHIFT_ROUND)
def a3b(spark, sf):
    return anomalies.volume_spikes(tables.transactions(spark, sf, "area"), Q2, per_month=False)


@register("a4_volume_drops", TX + _shift("area_name_en", IN_JUNE, BEFORE_JUNE, 12) + """
SELECT * FROM s WHERE historical_monthly_avg > 10 AND change_pct <= -15 ORDER BY change_pct, area_name_en LIMIT 10""", **SHIFT_ROUND)
def a4(spark, sf):
    return anomalies.volume_drops(tables.transactions(spark, sf, "area"), JUNE, threshold=-15.0)


@register("a5_new_developers", TX + """, k AS (
  SELECT developer, min(instance_date) AS first_sale_date, count(*) FILTER (instance_date >= DATE '1995-04-01' AND instance_date < DATE '1995-07-01') AS transaction_count,
    coalesce(sum(actual_worth) FILTER (instance_date >= DATE '1995-04-01' AND instance_date < DATE '1995-07-01'), 0) AS total_value,
    count(DISTINCT area_name_en) FILTER (instance_date >= DATE '1995-04-01' AND instance_date < DATE '1995-07-01') AS areas_active
  FROM tx WHERE developer <> '' GROUP BY 1)
SELECT * REPLACE (CAST(first_sale_date AS VARCHAR) AS first_sale_date) FROM k WHERE first_sale_date >= DATE '1995-02-01' AND transaction_count >= 5
ORDER BY transaction_count DESC, developer LIMIT 10""", r2="total_value")
def a5(spark, sf):
    df = tables.transactions(spark, sf, "area", "developer")
    return _text(anomalies.new_developers(df, Period(1995, "quarterly", 2), lookback_months=2), "first_sale_date")


@register("a6_developer_surges", TX + _shift("developer", IN_JUNE, BEFORE_JUNE, 12) + """
SELECT * FROM s WHERE historical_monthly_avg >= 2 AND current_count > 0 AND change_pct >= 50 ORDER BY change_pct DESC, developer LIMIT 10""", **SHIFT_ROUND)
def a6(spark, sf):
    return anomalies.developer_surges(tables.transactions(spark, sf, "developer"), JUNE, min_baseline=2.0)


@register("a7_month_subtraction", TX + """SELECT CAST(instance_date AS VARCHAR) AS instance_date,
  CAST(CAST(instance_date - INTERVAL 13 MONTH AS DATE) AS VARCHAR) AS months_before, count(*) AS tx_count FROM tx GROUP BY ALL""")
def a7(spark, sf):
    df = tables.transactions(spark, sf, "area")
    out = df.groupBy("instance_date", anomalies.months_before("instance_date", 13).alias("months_before")).agg(F.count(F.lit(1)).alias("tx_count"))
    return _text(out, "instance_date", "months_before")


@register("o1_emerging_hotspots", TX + f""", g AS (
  SELECT area_name_en, count(*) FILTER ({IN_Q2}) AS current_tx, count(*) FILTER ({BEFORE_Q2}) AS previous_tx,
    avg(actual_worth) FILTER ({IN_Q2}) AS current_price, avg(actual_worth) FILTER ({BEFORE_Q2}) AS previous_price FROM tx GROUP BY 1),
h AS (SELECT *, (current_tx - previous_tx) * 1.0::DOUBLE / previous_tx * 100 AS tx_growth, (current_price - previous_price) / previous_price * 100 AS price_growth
  FROM g WHERE current_tx >= 20 AND previous_tx >= 10)
SELECT *, tx_growth * 0.6 + price_growth * 0.4 AS momentum_score FROM h WHERE tx_growth >= 5 AND price_growth > 0 ORDER BY momentum_score DESC, area_name_en LIMIT 10""",
          r6="tx_growth price_growth momentum_score", r4="current_price previous_price")
def o1(spark, sf):
    return opportunities.emerging_hotspots(tables.transactions(spark, sf, "area"), Q2, min_growth=5.0)


@register("o2_undervalued_areas", TX + f""", a AS (
  SELECT area_name_en, count(*) AS tx_count, avg(meter_sale_price) AS avg_price_sqm, count(DISTINCT property_type) AS property_types,
    count(*) FILTER ({OFF}) * 100.0::DOUBLE / count(*) AS offplan_pct, count(*) FILTER (is_luxury) * 100.0::DOUBLE / count(*) AS luxury_pct
  FROM tx WHERE {IN_YEAR} AND meter_sale_price > 0 GROUP BY 1 HAVING count(*) >= 30),
c AS (SELECT x.area_name_en, count(*) AS comparables, avg(y.avg_price_sqm) AS comparable_avg_price_sqm,
    array_to_string(list(y.area_name_en ORDER BY y.avg_price_sqm, y.area_name_en)[1:5], ', ') AS comparable_areas
  FROM a x JOIN a y ON y.area_name_en <> x.area_name_en AND y.tx_count >= x.tx_count * 0.7 AND y.tx_count <= x.tx_count * 1.3 GROUP BY 1)
SELECT a.*, comparables, comparable_avg_price_sqm, comparable_areas, (avg_price_sqm - comparable_avg_price_sqm) / comparable_avg_price_sqm * 100 AS price_discount,
  (avg_price_sqm - (SELECT quantile_cont(avg_price_sqm, 0.5) FROM a)) / (SELECT quantile_cont(avg_price_sqm, 0.5) FROM a) * 100 AS vs_market_median
FROM a JOIN c USING (area_name_en) WHERE comparables >= 3 AND price_discount < -1 ORDER BY price_discount, area_name_en LIMIT 10""",
          r6="avg_price_sqm offplan_pct luxury_pct comparable_avg_price_sqm price_discount vs_market_median")
def o2(spark, sf):
    return opportunities.undervalued_areas(tables.transactions(spark, sf, "area", "type"), YEAR, max_discount=-1.0)


@register("o3_price_arbitrage", TX + f""", b AS (
  SELECT area_name_en, property_type, rooms_en, avg(actual_worth) AS p FROM tx WHERE {IN_YEAR} GROUP BY 1, 2, 3 HAVING count(*) >= 6),
g AS (SELECT property_type, rooms_en, count(*) AS area_count, max(p) AS max_price, min(p) AS min_price, avg(p) AS overall_avg,
    arg_max(area_name_en, p) AS high_price_area, arg_min(area_name_en, p) AS low_price_area FROM b GROUP BY 1, 2)
SELECT *, max_price - min_price AS price_difference, (max_price - min_price) / min_price * 100 AS arbitrage_pct FROM g
WHERE area_count >= 3 AND arbitrage_pct >= 20 ORDER BY arbitrage_pct DESC, property_type, rooms_en LIMIT 15""",
          r6="max_price min_price overall_avg price_difference arbitrage_pct")
def o3(spark, sf):
    return opportunities.price_arbitrage(tables.transactions(spark, sf, "area", "type", "rooms"), YEAR, min_rows=6)


MOMENTUM = f""", g AS (SELECT developer, count(*) FILTER ({IN_Q2}) AS current_tx, count(*) FILTER ({BEFORE_Q2}) AS previous_tx,
    coalesce(sum(actual_worth) FILTER ({IN_Q2}), 0) AS current_value FROM tx WHERE ({IN_Q2} OR {BEFORE_Q2}) AND developer <> '' GROUP BY 1),
s AS (SELECT *, current_tx * 100.0::DOUBLE / sum(current_tx) OVER () AS current_share, previous_tx * 100.0::DOUBLE / sum(previous_tx) OVER () AS previous_share FROM g),
f AS (SELECT developer, array_to_string(list_sort(list(DISTINCT area_name_en))[1:5], ', ') AS focus_areas FROM tx WHERE {IN_Q2} GROUP BY 1),
mo AS (SELECT *, current_share - previous_share AS share_change, CASE WHEN share_change > 0.3 THEN 'gaining' WHEN share_change < -0.3 THEN 'losing' ELSE 'stable' END AS trend
  FROM s LEFT JOIN f USING (developer) WHERE current_tx >= 8)"""
MOMENTUM_ROUND = {"r6": "current_share previous_share share_change", "r2": "current_value"}


def developer_momentum(spark, sf, limit=15):
    df = tables.transactions(spark, sf, "area", "developer")
    return opportunities.developer_momentum(df, Q2, min_rows=8, step=0.3, limit=limit)


@register("o4_developer_momentum", TX + MOMENTUM + "SELECT * FROM mo ORDER BY share_change DESC, developer LIMIT 15", **MOMENTUM_ROUND)
def o4(spark, sf):
    return developer_momentum(spark, sf)


@register("o5_yearly_growth", TX + """, g AS (SELECT area_name_en, count(*) FILTER (transaction_year = 2000) AS current_tx,
  count(*) FILTER (transaction_year = 1999) AS previous_tx, avg(actual_worth) FILTER (transaction_year = 2000) AS avg_price FROM tx GROUP BY 1)
SELECT *, (current_tx - previous_tx) * 1.0::DOUBLE / previous_tx * 100 AS growth_pct FROM g WHERE current_tx >= 100 AND previous_tx >= 50
ORDER BY growth_pct DESC, area_name_en LIMIT 15""", r6="growth_pct", r4="avg_price")
def o5(spark, sf):
    return opportunities.yearly_growth(tables.transactions(spark, sf, "area"), 2000, min_now=100, min_before=50)


YEARS = (1999, 2000, 2001)


def _study_sql(key):
    def growth(base, value):
        return f"CASE WHEN {base} > 0 THEN round(({value} - {base})::DOUBLE / {base} * 100, 2) WHEN {value} > 0 THEN 999999.0 ELSE 0.0 END"

    return f""", g AS (SELECT {key} AS name, {", ".join(
        f"count(*) FILTER (transaction_year = {y}) AS transactions_{i}, coalesce(avg(actual_worth) FILTER (transaction_year = {y}), 0) AS avg_value_{i}"
        for i, y in enumerate(YEARS, 1))} FROM tx WHERE transaction_year IN (1999, 2000, 2001) GROUP BY 1),
study AS (SELECT *, {growth("transactions_1", "transactions_2")} AS growth_2_pct, {growth("transactions_2", "transactions_3")} AS growth_3_pct,
  transactions_2 - transactions_1 AS change_2, transactions_3 - transactions_2 AS change_3, transactions_3 - transactions_1 AS change_total,
  CASE WHEN transactions_1 > 0 THEN round((pow(transactions_3::DOUBLE / transactions_1, 0.5) - 1) * 100, 2) WHEN transactions_3 > 0 THEN 999999.0 ELSE 0.0 END AS compound_growth_pct
  FROM g),
reasons AS (SELECT *, list_filter([
  CASE WHEN transactions_1 > 0 AND transactions_1 < 50 THEN 'starts from ' || transactions_1 || ' sales in 1999' END,
  CASE WHEN abs(growth_2_pct) > 200 AND abs(change_2) < 100 THEN '2000 moved by ' || round(growth_2_pct, 1) || '% on a difference of ' || abs(change_2) || ' sales' END,
  CASE WHEN abs(growth_3_pct) > 200 AND abs(change_3) < 100 THEN '2001 moved by ' || round(growth_3_pct, 1) || '% on a difference of ' || abs(change_3) || ' sales' END,
  CASE WHEN least(transactions_1, transactions_2, transactions_3) < 10 THEN 'hardly any sales: ' || array_to_string(list_filter([
    CASE WHEN transactions_1 < 10 THEN transactions_1 || ' in 1999' END, CASE WHEN transactions_2 < 10 THEN transactions_2 || ' in 2000' END,
    CASE WHEN transactions_3 < 10 THEN transactions_3 || ' in 2001' END], lambda x: x IS NOT NULL), ', ') END,
  CASE WHEN growth_2_pct = 999999 THEN 'nothing sold in 1999 to grow from' END,
  CASE WHEN growth_3_pct = 999999 THEN 'nothing sold in 2000 to grow from' END], lambda x: x IS NOT NULL) AS parts FROM study),
flagged AS (SELECT * EXCLUDE (parts), array_to_string(parts, '; ') AS misleading_reason, len(parts) > 0 AS misleading_flag FROM reasons)"""


STUDY = TX + _study_sql("area_name_en || ' / ' || property_type || ' / ' || rooms_en")


def _study(spark, sf):
    df = tables.transactions(spark, sf, "area", "type", "rooms")
    keyed = df.withColumn("scope", F.concat_ws(" / ", "area_name_en", "property_type", "rooms_en"))
    return opportunities.growth_study(keyed, "scope", YEARS)


def _flagged(spark, sf):
    return opportunities.with_misleading_flags(_study(spark, sf), YEARS)


@register("o6_growth_study", TX + _study_sql("area_name_en") + "SELECT * FROM study", r6="avg_value_1 avg_value_2 avg_value_3")
def o6(spark, sf):
    return opportunities.growth_study(tables.transactions(spark, sf, "area"), "area_name_en", YEARS)


@register("o7_misleading_growth", STUDY + "SELECT * FROM flagged", r6="avg_value_1 avg_value_2 avg_value_3")
def o7(spark, sf):
    return _flagged(spark, sf)


@register("o8_study_summary", STUDY + """
SELECT count(*) AS areas_analyzed, count(*) FILTER (misleading_flag) AS areas_misleading, count(*) FILTER (NOT misleading_flag) AS areas_legitimate,
  CAST(sum(transactions_1) AS BIGINT) AS transactions_1, CAST(sum(transactions_2) AS BIGINT) AS transactions_2, CAST(sum(transactions_3) AS BIGINT) AS transactions_3,
  (sum(transactions_3) - sum(transactions_1))::DOUBLE / sum(transactions_1) * 100 AS market_growth_pct,
  avg(compound_growth_pct) FILTER (compound_growth_pct <> 999999) AS avg_compound_growth,
  avg(compound_growth_pct) FILTER (compound_growth_pct <> 999999 AND NOT misleading_flag) AS avg_compound_growth_legitimate,
  quantile_cont(compound_growth_pct, 0.5) FILTER (compound_growth_pct <> 999999) AS median_compound_growth,
  count(*) FILTER (growth_2_pct > 50) AS growth_2_over_50, count(*) FILTER (growth_3_pct > 50) AS growth_3_over_50,
  count(*) FILTER (compound_growth_pct < 0) AS declining_areas, arg_max(name, (compound_growth_pct, name)) AS highest_growth_area,
  max(compound_growth_pct) AS highest_growth_pct, arg_min(name, (compound_growth_pct, name)) AS lowest_growth_area, min(compound_growth_pct) AS lowest_growth_pct
FROM flagged""", r6="market_growth_pct avg_compound_growth avg_compound_growth_legitimate median_compound_growth")
def o8(spark, sf):
    return opportunities.study_summary(_flagged(spark, sf), YEARS)


@register("o8_study_slices", STUDY + """
SELECT 'all' AS slice, name, compound_growth_pct FROM flagged
UNION ALL SELECT * FROM (SELECT 'top_legitimate', name, compound_growth_pct FROM flagged WHERE NOT misleading_flag ORDER BY compound_growth_pct DESC, name LIMIT 50)
UNION ALL SELECT 'misleading', name, compound_growth_pct FROM flagged WHERE misleading_flag
UNION ALL SELECT 'high_volume', name, compound_growth_pct FROM flagged WHERE transactions_2 > 12
UNION ALL SELECT 'declining', name, compound_growth_pct FROM flagged WHERE compound_growth_pct < -10""")
def o8b(spark, sf):
    slices = opportunities.study_slices(_flagged(spark, sf), high_volume=12)
    parts = [df.select(F.lit(name).alias("slice"), "name", "compound_growth_pct") for name, df in slices.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MONTHLY = """, m AS (SELECT area_name_en, date_trunc('month', instance_date) AS mo, count(*) AS n, avg(actual_worth) AS ap FROM tx
  WHERE instance_date < DATE '2000-12-01' AND instance_date >= DATE '2000-12-01' - INTERVAL 13 MONTH GROUP BY 1, 2)"""
PRICE_MOMENTUM = MONTHLY + """, r AS (SELECT *, row_number() OVER w AS rn, (ap - lead(ap) OVER w) / lead(ap) OVER w AS ch FROM m WHERE n >= 10
  WINDOW w AS (PARTITION BY area_name_en ORDER BY mo DESC)),
g AS (SELECT area_name_en, count(*) AS months, count(ch) AS t, count(*) FILTER (ch > 0.01) AS up, count(*) FILTER (ch < -0.01) AS dn,
    max(ap) FILTER (rn = 1) AS p0, max(ap) FILTER (rn = 4) AS p3, max(ap) FILTER (rn = 7) AS p6, max(ap) FILTER (rn = 13) AS p12,
    avg(ch) FILTER (rn <= 3) AS recent, avg(ch) FILTER (rn BETWEEN 4 AND 6) AS older FROM r GROUP BY 1),
pm AS (SELECT s.area_name_en, CASE WHEN months >= 2 THEN p0 ELSE 0 END AS current_avg_price,
  CASE WHEN months >= 2 THEN (p0 - p3) / p3 * 100 END AS momentum_3m, CASE WHEN months >= 2 THEN (p0 - p6) / p6 * 100 END AS momentum_6m,
  CASE WHEN months >= 2 THEN (p0 - p12) / p12 * 100 END AS momentum_12m,
  CASE WHEN coalesce(months, 0) < 4 THEN 'stable' WHEN up >= t * 0.7 THEN CASE WHEN recent > coalesce(older, recent) * 1.2 THEN 'accelerating' ELSE 'stable' END
    WHEN dn >= t * 0.7 THEN 'decelerating' WHEN abs(up - dn) > t * 0.5 THEN 'volatile' ELSE 'stable' END AS trajectory,
  CASE WHEN coalesce(months, 0) < 4 THEN 0.0 WHEN up >= t * 0.7 THEN up::DOUBLE / t WHEN dn >= t * 0.7 THEN dn::DOUBLE / t
    WHEN abs(up - dn) > t * 0.5 THEN 0.3 ELSE (t - up - dn)::DOUBLE / t END AS consistency_score
  FROM (SELECT DISTINCT area_name_en FROM m) s LEFT JOIN g USING (area_name_en))"""
PM_ROUND = "momentum_3m momentum_6m momentum_12m consistency_score"
AREA = ["area_name_en"]


@register("t1_price_momentum", TX + PRICE_MOMENTUM + "SELECT area_name_en, current_avg_price, momentum_3m, momentum_6m, momentum_12m FROM pm",
          r6="momentum_3m momentum_6m momentum_12m", r4="current_avg_price")
def t1(spark, sf):
    return trends.price_momentum(tables.transactions(spark, sf, "area"), AREA, AS_OF).drop("trajectory", "consistency_score")


@register("t2_trajectory", TX + PRICE_MOMENTUM + "SELECT area_name_en, trajectory, consistency_score FROM pm", r6="consistency_score")
def t2(spark, sf):
    return trends.price_momentum(tables.transactions(spark, sf, "area"), AREA, AS_OF).select("area_name_en", "trajectory", "consistency_score")


@register("t1_price_momentum_market", TX + MONTHLY.replace("area_name_en, ", "").replace("GROUP BY 1, 2", "GROUP BY 1") + """,
r AS (SELECT *, row_number() OVER (ORDER BY mo DESC) AS rn FROM m WHERE n >= 10),
g AS (SELECT max(ap) FILTER (rn = 1) AS p0, max(ap) FILTER (rn = 4) AS p3, max(ap) FILTER (rn = 7) AS p6, max(ap) FILTER (rn = 13) AS p12 FROM r)
SELECT p0 AS current_avg_price, (p0 - p3) / p3 * 100 AS momentum_3m, (p0 - p6) / p6 * 100 AS momentum_6m, (p0 - p12) / p12 * 100 AS momentum_12m FROM g""",
          r6="momentum_3m momentum_6m momentum_12m", r4="current_avg_price")
def t1b(spark, sf):
    return trends.price_momentum(tables.transactions(spark, sf, "area"), [], AS_OF).drop("trajectory", "consistency_score")


VOLUME_MOMENTUM = MONTHLY + """, r AS (SELECT *, row_number() OVER (PARTITION BY area_name_en ORDER BY mo DESC) AS rn FROM m),
g AS (SELECT area_name_en, count(*) AS months, max(n) FILTER (rn = 1) AS n0, max(n) FILTER (rn = 4) AS n3, max(n) FILTER (rn = 7) AS n6, max(n) FILTER (rn = 13) AS n12 FROM r GROUP BY 1),
vm AS (SELECT area_name_en, CASE WHEN months >= 2 THEN n0 ELSE 0 END AS current_monthly_volume, CASE WHEN months >= 2 THEN (n0 - n3)::DOUBLE / n3 * 100 END AS volume_3m_change,
  CASE WHEN months >= 2 THEN (n0 - n6)::DOUBLE / n6 * 100 END AS volume_6m_change, CASE WHEN months >= 2 THEN (n0 - n12)::DOUBLE / n12 * 100 END AS volume_12m_change,
  CASE WHEN months < 2 THEN 'insufficient_data' WHEN (n0 - n3)::DOUBLE / n3 * 100 > 15 THEN 'increasing' WHEN (n0 - n3)::DOUBLE / n3 * 100 < -15 THEN 'decreasing' ELSE 'stable' END AS volume_trend FROM g)"""


@register("t3_volume_momentum", TX + VOLUME_MOMENTUM + "SELECT * FROM vm", r6="volume_3m_change volume_6m_change volume_12m_change")
def t3(spark, sf):
    return trends.volume_momentum(tables.transactions(spark, sf, "area"), AREA, AS_OF)


SEASON = """, sy AS (SELECT area_name_en, month(instance_date) AS mn, count(*) AS n, (SELECT count(*) FROM range(TIMESTAMP '1998-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH) c(m) WHERE month(m) = mn) AS often
  FROM tx WHERE instance_date >= DATE '1998-01-01' AND instance_date < DATE '2000-12-01' GROUP BY 1, 2),
sm AS (SELECT *, n::DOUBLE / often AS yearly FROM sy), si AS (SELECT *, yearly / avg(yearly) OVER (PARTITION BY area_name_en) * 100 AS ix FROM sm),
sr AS (SELECT *, row_number() OVER (PARTITION BY area_name_en ORDER BY ix DESC, mn) AS rn, count(*) OVER (PARTITION BY area_name_en) AS c,
  ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][mn] AS nm FROM si),
se AS (SELECT area_name_en, array_to_string(list(nm ORDER BY rn) FILTER (rn <= 3), ', ') AS peak_months, array_to_string(list(nm ORDER BY rn) FILTER (rn > c - 3), ', ') AS low_months,
  avg(ix) FILTER (rn <= 3) / avg(ix) FILTER (rn > c - 3) AS peak_vs_low_ratio,
  CASE WHEN coalesce(max(ix) FILTER (mn = 11), 100) >= 110 THEN 'peak' WHEN coalesce(max(ix) FILTER (mn = 11), 100) <= 90 THEN 'low' ELSE 'normal' END AS current_month_position
  FROM sr GROUP BY 1)"""


@register("t4_seasonality", TX + SEASON + "SELECT * FROM se", r6="peak_vs_low_ratio")
def t4(spark, sf):
    return trends.seasonality(tables.transactions(spark, sf, "area"), AREA, SEASON_START, AS_OF)


@register("t4_month_indices", TX + SEASON + "SELECT area_name_en, CAST(mn AS INTEGER) AS month_number, n AS tx_count, ix AS month_index FROM si", r6="month_index")
def t4b(spark, sf):
    return trends.month_indices(tables.transactions(spark, sf, "area"), AREA, SEASON_START, AS_OF)


CYCLE = """, cq AS (SELECT area_name_en, date_trunc('quarter', instance_date) AS q, count(*) AS n, avg(actual_worth) AS ap FROM tx
  WHERE instance_date < DATE '2000-10-01' AND instance_date >= DATE '2000-10-01' - INTERVAL 24 MONTH GROUP BY 1, 2),
cc AS (SELECT *, row_number() OVER w AS rn, (ap - lead(ap) OVER w) / lead(ap) OVER w AS pc, (n - lead(n) OVER w)::DOUBLE / lead(n) OVER w AS vc FROM cq
  WINDOW w AS (PARTITION BY area_name_en ORDER BY q DESC)),
ct AS (SELECT *, avg(pc) FILTER (rn <= 2) OVER (PARTITION BY area_name_en) AS tr FROM cc),
cs AS (SELECT area_name_en, count(*) AS quarters, count(pc) AS nc, max(tr) AS p, avg(vc) FILTER (rn <= 2) AS v,
  min(rn) FILTER (rn >= 2 AND pc IS NOT NULL AND NOT ((pc > 0 AND tr > 0) OR (pc < 0 AND tr < 0))) AS br FROM ct GROUP BY 1),
cy AS (SELECT area_name_en,
  CASE WHEN quarters < 3 THEN 'stable' WHEN p > 0.03 AND v > 0.05 THEN 'growth' WHEN p > 0.02 AND v < -0.05 THEN 'peak' WHEN p < -0.02 THEN 'correction'
    WHEN p > 0 AND v > 0.1 THEN 'recovery' ELSE 'stable' END AS phase,
  CASE WHEN quarters < 3 THEN 0.3 WHEN p > 0.03 AND v > 0.05 THEN least(0.9, 0.5 + abs(p) + abs(v)) WHEN p > 0.02 AND v < -0.05 THEN 0.6
    WHEN p < -0.02 THEN least(0.8, 0.5 + abs(p)) WHEN p > 0 AND v > 0.1 THEN 0.6 ELSE 0.5 END AS phase_confidence,
  CAST(CASE WHEN quarters < 3 THEN 0 ELSE (coalesce(br, nc + 1) - 1) * 3 END AS INTEGER) AS phase_duration_months,
  CASE WHEN quarters >= 3 THEN p * 100 END AS recent_price_trend_qoq, CASE WHEN quarters >= 3 THEN v * 100 END AS recent_volume_trend_qoq, quarters AS quarters_analyzed FROM cs)"""


@register("t5_market_cycle", TX + CYCLE + "SELECT * FROM cy", r6="phase_confidence recent_price_trend_qoq recent_volume_trend_qoq")
def t5(spark, sf):
    return trends.market_cycle(tables.transactions(spark, sf, "area"), AREA, AS_OF)


TREND_ROUND = {
    "r6": f"{PM_ROUND} volume_3m_change volume_6m_change volume_12m_change peak_vs_low_ratio phase_confidence recent_price_trend_qoq recent_volume_trend_qoq",
    "r4": "current_avg_price",
}
COMBINED = PRICE_MOMENTUM + VOLUME_MOMENTUM.removeprefix(MONTHLY).replace(", r AS", ", vr AS").replace("FROM r GROUP", "FROM vr GROUP").replace("g AS (", "vg AS (").replace("FROM g)", "FROM vg)") + SEASON + CYCLE
COMBINED_SELECT = "pm JOIN vm USING (area_name_en) JOIN se USING (area_name_en) JOIN cy USING (area_name_en)"


@register("t6_combined_trends", TX + COMBINED + f"SELECT * FROM {COMBINED_SELECT}", **TREND_ROUND)
def t6(spark, sf):
    return trends.combined_trends(tables.transactions(spark, sf, "area"), AREA, AS_OF, SEASON_START)


# The same in the middle of a month: the running month and quarter are left out.
MID = date(2000, 8, 20)


def _mid(sql: str) -> str:
    return TX + sql.replace("2000-12-01", "2000-08-01").replace("2000-10-01", "2000-07-01").replace("mn = 11", "mn = 8")


@register("t1_price_momentum_mid_month", _mid(PRICE_MOMENTUM + "SELECT * FROM pm"), r6=PM_ROUND, r4="current_avg_price")
def t1c(spark, sf):
    return trends.price_momentum(tables.transactions(spark, sf, "area"), AREA, MID)


@register("t3_volume_momentum_mid_month", _mid(VOLUME_MOMENTUM + "SELECT * FROM vm"), r6="volume_3m_change volume_6m_change volume_12m_change")
def t3b(spark, sf):
    return trends.volume_momentum(tables.transactions(spark, sf, "area"), AREA, MID)


@register("t4_seasonality_mid_month", _mid(SEASON + "SELECT * FROM se"), r6="peak_vs_low_ratio")
def t4c(spark, sf):
    return trends.seasonality(tables.transactions(spark, sf, "area"), AREA, SEASON_START, MID)


@register("t5_market_cycle_mid_quarter", _mid(CYCLE + "SELECT * FROM cy"), r6="phase_confidence recent_price_trend_qoq recent_volume_trend_qoq")
def t5b(spark, sf):
    return trends.market_cycle(tables.transactions(spark, sf, "area"), AREA, MID)


@register("t6_combined_trends_mid_month", _mid(COMBINED + f"SELECT * FROM {COMBINED_SELECT}"), **TREND_ROUND)
def t6b(spark, sf):
    return trends.combined_trends(tables.transactions(spark, sf, "area"), AREA, MID, SEASON_START)


SEGMENT = "CASE WHEN {0} < 20000 THEN 'affordable' WHEN {0} < 50000 THEN 'mid_market' WHEN {0} < 95000 THEN 'mid_luxury' WHEN {0} < 102000 THEN 'luxury' ELSE 'ultra_luxury' END"
PROFILES = f""", ap AS (SELECT area_name_en, count(*) AS total_transactions, avg(actual_worth) AS avg_price, avg(meter_sale_price) AS avg_price_sqm,
  min(actual_worth) AS min_price, max(actual_worth) AS max_price, avg(procedure_area) AS avg_unit_size_sqm, count(DISTINCT project_name_en) AS unique_projects,
  count(DISTINCT developer) AS unique_developers, count(*) FILTER ({OFF}) * 100.0::DOUBLE / count(*) AS offplan_pct,
  count(*) FILTER (is_luxury) * 100.0::DOUBLE / count(*) AS luxury_pct, {SEGMENT.format("avg(actual_worth)")} AS market_segment FROM tx GROUP BY 1),
near AS (SELECT x.area_name_en, y.area_name_en AS comparable, abs(y.avg_price - x.avg_price) / x.avg_price AS distance,
    row_number() OVER (PARTITION BY x.area_name_en ORDER BY distance, y.area_name_en) AS nearness
  FROM ap x JOIN ap y ON x.area_name_en <> y.area_name_en AND y.avg_price BETWEEN x.avg_price * 0.7 AND x.avg_price * 1.3
    AND y.total_transactions BETWEEN x.total_transactions * 0.5 AND x.total_transactions * 2.0 QUALIFY nearness <= 5)"""
PROFILE_ROUND = {"r6": "avg_price_sqm avg_unit_size_sqm offplan_pct luxury_pct", "r4": "avg_price"}


@register("c1_area_dna", TX + PROFILES + """, cmp AS (SELECT area_name_en, array_to_string(list(comparable ORDER BY nearness), ', ') AS comparable_areas FROM near GROUP BY 1),
mix AS (SELECT area_name_en, property_type, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY area_name_en), 4) AS pct FROM tx GROUP BY 1, 2),
rm AS (SELECT area_name_en, rooms_en, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY area_name_en), 4) AS pct FROM tx GROUP BY 1, 2)
SELECT ap.*, comparable_areas, (SELECT array_to_string(list(property_type || '=' || CAST(pct AS DECIMAL(9, 4)) ORDER BY property_type), ', ') FROM mix WHERE mix.area_name_en = ap.area_name_en) AS transaction_mix,
  (SELECT array_to_string(list(rooms_en || '=' || CAST(pct AS DECIMAL(9, 4)) ORDER BY rooms_en), ', ') FROM rm WHERE rm.area_name_en = ap.area_name_en) AS room_distribution
FROM ap LEFT JOIN cmp USING (area_name_en)""", **PROFILE_ROUND)
def c1(spark, sf):
    df = profiles.area_dna(tables.transactions(spark, sf), EDGES)

    def shown(c):
        entries = F.map_entries(c)
        text = F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 4).cast("decimal(9,4)").cast("string")))
        return F.array_join(text, ", ")

    return df.withColumns(
        {
            "transaction_mix": shown("transaction_mix"),
            "room_distribution": shown("room_distribution"),
            "comparable_areas": F.array_join("comparable_areas", ", "),
        }
    )


@register("c1_area_mixes", TX + """
SELECT 'property_type' AS mix, area_name_en, property_type AS item, count(*) AS tx_count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY area_name_en) AS pct FROM tx GROUP BY 2, 3
UNION ALL SELECT 'rooms', area_name_en, rooms_en, count(*), count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY area_name_en) FROM tx GROUP BY 2, 3""", r6="pct")
def c1b(spark, sf):
    return profiles.area_mixes(tables.transactions(spark, sf, "area", "type", "rooms"))


@register("c2_segment_of_price", TX + f"SELECT {SEGMENT.format('actual_worth')} AS segment, count(*) AS tx_count, min(actual_worth) AS lowest, max(actual_worth) AS highest FROM tx GROUP BY 1")
def c2(spark, sf):
    df = tables.transactions(spark, sf, "area")
    return df.groupBy(profiles.segment_of("actual_worth", EDGES).alias("segment")).agg(
        F.count(F.lit(1)).alias("tx_count"), F.min("actual_worth").alias("lowest"), F.max("actual_worth").alias("highest")
    )


@register("c3_comparable_areas", TX + PROFILES + "SELECT * FROM near", r6="distance")
def c3(spark, sf):
    return profiles.comparable_areas(tables.transactions(spark, sf, "area"))


# Projects of one area stand for areas, so that there are many and their sizes differ.
@register("c3_comparable_projects", TX + """, ap AS (SELECT area_name_en || ' ' || project_name_en AS area_name_en, count(*) AS n, avg(actual_worth) AS p FROM tx GROUP BY 1)
SELECT x.area_name_en, y.area_name_en AS comparable, abs(y.p - x.p) / x.p AS distance, row_number() OVER (PARTITION BY x.area_name_en ORDER BY distance, y.area_name_en) AS nearness
FROM ap x JOIN ap y ON x.area_name_en <> y.area_name_en AND y.p BETWEEN x.p * 0.7 AND x.p * 1.3 AND y.n BETWEEN x.n * 0.5 AND x.n * 2.0 QUALIFY nearness <= 5""", r6="distance")
def c3b(spark, sf):
    df = tables.transactions(spark, sf, "area", "project")
    return profiles.comparable_areas(df.withColumn("area_name_en", F.concat_ws(" ", "area_name_en", "project_name_en")))


@register("c4_compare_areas", TX + PROFILES + """, pr AS (
  SELECT x.area_name_en AS area_1, y.area_name_en AS area_2, (x.avg_price - y.avg_price) / y.avg_price * 100 AS price_difference_pct,
    (x.total_transactions - y.total_transactions)::DOUBLE / y.total_transactions * 100 AS volume_difference_pct, x.market_segment = y.market_segment AS segment_match
  FROM near JOIN ap x USING (area_name_en) JOIN ap y ON y.area_name_en = comparable)
SELECT *, greatest(0.0, least(1.0, 1 - abs(price_difference_pct) / 200 - abs(volume_difference_pct) / 200 - CASE WHEN segment_match THEN 0 ELSE 0.2 END)) AS similarity_score FROM pr""",
          r6="price_difference_pct volume_difference_pct similarity_score")
def c4(spark, sf):
    df = tables.transactions(spark, sf, "area", "developer", "project")
    pairs = profiles.comparable_areas(df).select(F.col("area_name_en").alias("area_1"), F.col("comparable").alias("area_2"))
    return profiles.compare_pairs(profiles.area_profiles(df, EDGES), pairs)


DEVELOPERS = f""", dp AS (SELECT developer, count(*) AS total_transactions, avg(actual_worth) AS avg_transaction_value,
  count(*) FILTER ({OFF}) * 100.0::DOUBLE / count(*) AS offplan_pct, {SEGMENT.format("avg(actual_worth)")} AS market_segment,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tx) AS market_share FROM tx WHERE developer <> '' GROUP BY 1)"""


@register("c5_developer_profiles", TX + DEVELOPERS + "SELECT * FROM dp", r6="offplan_pct market_share", r4="avg_transaction_value")
def c5(spark, sf):
    return profiles.developer_profiles(tables.transactions(spark, sf, "developer"), EDGES)


@register("c5_developer_areas", TX + """SELECT developer, area_name_en, count(*) AS tx_count,
  row_number() OVER (PARTITION BY developer ORDER BY count(*) DESC, area_name_en) AS area_rank FROM tx GROUP BY 1, 2 QUALIFY area_rank <= 5""")
def c5b(spark, sf):
    return profiles.developer_areas(tables.transactions(spark, sf, "area", "developer"))


@register("c5_developer_types", TX + """SELECT developer, property_type, count(*) AS tx_count,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY developer) AS pct FROM tx GROUP BY 1, 2""", r6="pct")
def c5c(spark, sf):
    return profiles.developer_types(tables.transactions(spark, sf, "developer", "type"))


def _concentration(name):
    return f"""SELECT '{name}' AS dimension, CAST(sum(n) AS BIGINT) AS total_transactions, sum(n) FILTER (rn <= 5) * 100.0::DOUBLE / sum(n) AS top_5_share,
  sum(n) FILTER (rn <= 10) * 100.0::DOUBLE / sum(n) AS top_10_share, array_to_string(list(k ORDER BY rn) FILTER (rn <= 5), ', ') AS leaders
FROM (SELECT {name} AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {name}) AS rn FROM tx WHERE {name} <> '' GROUP BY 1)"""


@register("c6_market_concentration", TX + _concentration("area_name_en") + " UNION ALL " + _concentration("developer"), r6="top_5_share top_10_share")
def c6(spark, sf):
    return profiles.market_concentration(tables.transactions(spark, sf, "area", "developer"))


@register("c6_segment_distribution", TX + f"SELECT {SEGMENT.format('actual_worth')} AS segment, count(*) AS tx_count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM tx GROUP BY 1", r6="pct")
def c6b(spark, sf):
    return profiles.segment_distribution(tables.transactions(spark, sf, "area"), EDGES)


@register("c7_area_list", TX + """SELECT area_name_en, count(*) AS total_transactions, avg(actual_worth) AS avg_price, quantile_cont(actual_worth, 0.5) AS median_price
FROM tx WHERE area_name_en IN ('NATION_1', 'NATION_7', 'NATION_19') GROUP BY 1 HAVING count(*) >= 10""", r4="avg_price median_price")
def c7(spark, sf):
    table = area_metrics(tables.transactions(spark, sf, "area", "developer", "project", "type"))
    out = profiles.area_list(table, ["NATION_1", "NATION_7", "NATION_19"])
    return out.select("area_name_en", "total_transactions", "avg_price", "median_price")
