"""Registered queries: sources, normalisation, validation, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import TX, register
from marketspark.config import PriceRule
from marketspark.operators import ingest
from marketspark.sources import driver_tables as tables
from marketspark.sources.readers import SUPPLY_COLUMNS, TRANSACTIONS, parse_supply, parse_transactions, read_warehouse, source_profile

# Price limits that select something in the sample data, by part type.
SAMPLE_RULES = {
    "STANDARD": PriceRule(5_000, 100_000, 10_000, 95_000),
    "ECONOMY": PriceRule(3_000, 90_000, 8_000, 85_000),
    "MEDIUM": PriceRule(2_000, 104_000, 20_000, 99_000),
    "PROMO": PriceRule(1_500, 98_000, 5_000, 92_000),
    "LARGE": PriceRule(10_000, 105_000, 30_000, 101_000),
}
SAMPLE_SQM = PriceRule(950, 2_050, 1_000, 2_000)
RULE_ROWS = ", ".join(
    f"('{k}', {r.minimum}, {r.maximum}, {r.warn_below}, {r.warn_above})" for k, r in SAMPLE_RULES.items()
)
RULES_CTE = f", rules AS (SELECT * FROM (VALUES {RULE_ROWS}) v(kind, lo, hi, warn_lo, warn_hi))"


@register("s1_transactions_scan", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS transaction_year, count(*) AS records, sum(l_extendedprice) AS volume
FROM lineitem GROUP BY 1""", r2="volume")
def s1(spark, sf):
    df = tables.table(spark, sf, "lineitem")
    return df.groupBy(F.year("l_shipdate").alias("transaction_year")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("l_extendedprice").alias("volume")
    )


@register("s2_warehouse_pull", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS evidence_date
FROM lineitem WHERE l_shipdate >= '2000-01-01' AND l_shipdate < '2001-01-01'""")
def s2(spark, sf):
    df = read_warehouse(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"], year=2000, day="l_shipdate")
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").cast("date").cast("string").alias("evidence_date"))


# Every sale written as a line of the transactions file and read again with the reader's schema and options.
@register("s1_transactions_csv", """
SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS instance_date, l_returnflag AS reg_type_en,
  CAST(l_suppkey AS VARCHAR) AS area_name_en, l_quantity AS procedure_area, l_extendedprice AS actual_worth FROM lineitem""", r2="actual_worth procedure_area")
def s1b(spark, sf):
    blank = F.lit(None).cast("string")
    given = {
        "transaction_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "instance_date": F.col("l_shipdate").cast("date").cast("string"), "reg_type_en": F.col("l_returnflag"),
        "area_name_en": F.col("l_suppkey").cast("string"), "procedure_area": F.col("l_quantity").cast("string"), "actual_worth": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
    }
    fields = [given.get(f.name, blank).alias(f.name) for f in TRANSACTIONS.fields]
    lines = tables.table(spark, sf, "lineitem").select(F.to_csv(F.struct(*fields), {"nullValue": "null"}).alias("line"))
    return parse_transactions(lines).select(*given)


# The same for the supply list.
@register("s3_supply_csv", """
SELECT CAST(o_orderkey AS VARCHAR) AS project_id, 'Tower, "' || o_orderkey || '"' AS project_name, CAST(o_custkey AS VARCHAR) AS developer,
  CAST(o_orderkey % 500 AS INTEGER) AS total_units, CAST(o_orderkey % 101 AS INTEGER) AS completion_percentage FROM orders""")
def s3b(spark, sf):
    blank = F.lit(None).cast("string")
    key = F.col("o_orderkey")
    given = {
        "ID": key.cast("string"), "Project_Name": F.concat(F.lit('Tower, "'), key.cast("string"), F.lit('"')), "Developer": F.col("o_custkey").cast("string"),
        "Total_Units": (key % 500).cast("double").cast("string"), "Completion_Percentage": (key % 101).cast("double").cast("string"),
    }
    fields = [given.get(c, blank).alias(c) for c in SUPPLY_COLUMNS]
    lines = tables.table(spark, sf, "orders").select(F.to_csv(F.struct(*fields)).alias("line"))
    return parse_supply(lines).select("project_id", "project_name", "developer", "total_units", "completion_percentage")


@register("s11_source_profile", TX + """
SELECT 'overall' AS section, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM tx
UNION ALL SELECT 'overall', 'first_date', CAST(min(instance_date) AS VARCHAR) FROM tx
UNION ALL SELECT 'overall', 'last_date', CAST(max(instance_date) AS VARCHAR) FROM tx
UNION ALL SELECT 'type', property_type, CAST(count(*) AS VARCHAR) FROM tx GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'area', area_name_en, CAST(count(*) AS VARCHAR) FROM tx GROUP BY 2 ORDER BY count(*) DESC, area_name_en LIMIT 10)""")
def s11(spark, sf):
    return source_profile(tables.transactions(spark, sf, "area", "type"), "instance_date", "property_type", "area_name_en")


VERSIONS = """
WITH v AS (
  SELECT CAST(1 + o_orderkey % 6 AS INTEGER) AS version_id,
    CASE WHEN o_orderkey % 6 IN (1, 4) THEN 'Supply: ' ELSE 'Sales: ' END || (1 + o_orderkey % 6) AS version_name,
    max(o_orderdate) AS import_date, count(*) AS record_count
  FROM orders GROUP BY 1, 2)
"""


def _versions(spark, sf):
    group = F.col("o_orderkey") % 6
    return (
        tables.table(spark, sf, "orders")
        .groupBy(
            (1 + group).cast("int").alias("version_id"),
            F.concat(F.when(group.isin(1, 4), "Supply: ").otherwise("Sales: "), (1 + group).cast("string")).alias("version_name"),
        )
        .agg(F.max("o_orderdate").alias("import_date"), F.count(F.lit(1)).alias("record_count"))
    )


@register("e1_next_version_id", VERSIONS + "SELECT CAST(coalesce(max(version_id), 0) + 1 AS INTEGER) AS next_version_id FROM v")
def e1(spark, sf):
    return ingest.next_version_id(_versions(spark, sf))


@register("e2_active_versions", VERSIONS + """
SELECT version_id, version_name, record_count,
  CASE WHEN version_name LIKE 'Supply:%' THEN 'supply' ELSE 'sales' END AS version_family,
  version_id = max(version_id) OVER (PARTITION BY version_name LIKE 'Supply:%') AS is_active FROM v""")
def e2(spark, sf):
    return ingest.with_active_flag(_versions(spark, sf)).drop("import_date")


LOADED = """
WITH loaded AS (SELECT *, CAST(1 + l_orderkey % 6 AS INTEGER) AS version_id FROM lineitem)
"""


@register("e3_current_version", LOADED + """
SELECT l_orderkey, l_linenumber, l_extendedprice, version_id FROM loaded
WHERE version_id = (SELECT max(1 + o_orderkey % 6) FROM orders WHERE o_orderkey % 6 NOT IN (1, 4))""")
def e3(spark, sf):
    loaded = tables.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (1 + F.col("l_orderkey") % 6).cast("int").alias("version_id")
    )
    return ingest.current_version(loaded, ingest.with_active_flag(_versions(spark, sf)))


@register("e4_clean_view", TX + """
SELECT transaction_type, count(*) AS records, sum(actual_worth) AS volume FROM all_tx
WHERE is_valid AND quality_score >= 0.7 AND transaction_type <> 'Unknown' GROUP BY 1""", r2="volume")
def e4(spark, sf):
    df = ingest.clean(tables.all_transactions(spark, sf, "area"))
    return df.groupBy("transaction_type").agg(F.count(F.lit(1)).alias("records"), F.sum("actual_worth").alias("volume"))


@register("e5_luxury_view", TX + "SELECT transaction_id, actual_worth, area_name_en FROM tx WHERE is_luxury")
def e5(spark, sf):
    return ingest.luxury(tables.transactions(spark, sf, "area")).select("transaction_id", "actual_worth", "area_name_en")


VERIFIED = """SELECT transaction_id, CAST(instance_date AS VARCHAR) AS instance_date, property_type, transaction_type, originally_offplan,
  CASE WHEN transaction_type = 'Off-Plan' THEN 'Off-Plan (Developer Sale)'
    WHEN transaction_type = 'Existing' AND originally_offplan THEN 'Resale (Off-Plan Origin)'
    WHEN transaction_type = 'Existing' THEN 'Resale' END AS sale_classification,
  area_name_en, project_name_en, developer, rooms_en, procedure_area, actual_worth, meter_sale_price, is_luxury,
  transaction_year, transaction_month FROM tx"""


@register("e6_verified_view", TX + VERIFIED)
def e6(spark, sf):
    return ingest.verified(tables.transactions(spark, sf)).withColumn("instance_date", F.col("instance_date").cast("string"))


@register("e7_verified_luxury_view", TX + VERIFIED + " WHERE is_luxury")
def e7(spark, sf):
    df = ingest.verified(ingest.luxury(tables.transactions(spark, sf)))
    return df.withColumn("instance_date", F.col("instance_date").cast("string"))


def _feed(spark, sf):
    """Unique lines under the warehouse feed's column names, with its spellings and gaps."""
    size = F.col("p_size") % 9
    part = tables.table(spark, sf, "part")
    supplier = tables.table(spark, sf, "supplier")
    nation = tables.table(spark, sf, "nation")
    return (
        tables.unique_lines(spark, sf)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            F.col("l_shipdate").cast("date").alias("evidence_date"),
            F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("master_development"),
            F.col("p_name").alias("sub_loc_1"),
            F.col("s_name").alias("dev_name"),
            F.when(size == 0, "s").when(size == 8, "7+").otherwise(size.cast("string")).alias("no_beds"),
            F.col("l_quantity").alias("unit_bua_sqm"),
            F.col("l_extendedprice").alias("total_sales_price"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("sales_price_sqm_unit"),
            F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "Apartment").when(F.col("p_type") == "MEDIUM", "Villa")
            .when(F.col("p_type") == "SMALL", "Townhouse").when(F.col("p_type") == "PROMO", "Whole Building")
            .otherwise("Hotel Apartment").alias("unit_type"),
            F.when(F.col("l_returnflag") == "N", "Offplan").when(F.col("l_returnflag") == "A", "ReSale").alias("sale_sequence"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("off_plan"),
            F.year("l_shipdate").alias("Year"),
            F.month("l_shipdate").alias("Month"),
        )
    )


FEED = TX + """, feed AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS instance_date,
    CASE WHEN n_nationkey <> 3 THEN n_name END AS area_name_en, l_extendedprice AS actual_worth,
    CASE WHEN p_size % 9 = 0 THEN 'Studio' WHEN p_size % 9 = 8 THEN '7+ B/R' ELSE (p_size % 9) || ' B/R' END AS rooms_en,
    CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'Apartment' WHEN p_type = 'MEDIUM' THEN 'Villa' WHEN p_type = 'SMALL' THEN 'Townhouse'
      WHEN p_type = 'PROMO' THEN 'Whole Building' ELSE 'Hotel Apartment' END AS property_type,
    CASE WHEN p_type = 'MEDIUM' THEN 'Villa' WHEN p_type = 'SMALL' THEN 'Townhouse' WHEN p_type = 'PROMO' THEN 'Building' ELSE 'Unit' END AS property_type_en,
    CASE l_returnflag WHEN 'N' THEN 'Off-Plan' WHEN 'A' THEN 'Existing' ELSE 'Unknown' END AS transaction_type,
    l_linestatus = 'O' AS originally_offplan
  FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


@register("e8_row_mapping", FEED + "SELECT * FROM feed")
def e8(spark, sf):
    df = ingest.map_warehouse_rows(_feed(spark, sf))
    return df.select(
        "transaction_id", F.col("instance_date").cast("string").alias("instance_date"), "area_name_en", "actual_worth",
        "rooms_en", "property_type", "property_type_en", "transaction_type", "originally_offplan",
    )


@register("e9_row_validation", FEED + """, judged AS (
  SELECT *, property_type IN ('Apartment', 'Townhouse', 'Villa') AND actual_worth > 0
    AND actual_worth >= CASE property_type_en WHEN 'Unit' THEN 50000 ELSE 100000 END AS is_valid FROM feed)
SELECT property_type, is_valid, CASE WHEN NOT is_valid THEN 0.0 WHEN area_name_en IS NULL THEN 0.8 ELSE 1.0 END AS quality_score,
  is_valid AND actual_worth >= 95000 AS is_luxury, count(*) AS records
FROM judged GROUP BY ALL""", r6="quality_score")
def e9(spark, sf):
    df = ingest.validate_warehouse_rows(
        ingest.map_warehouse_rows(_feed(spark, sf)), tables.MarketConfig(luxury_price=95_000)
    )
    return df.groupBy("property_type", "is_valid", "quality_score", "is_luxury").agg(F.count(F.lit(1)).alias("records"))


@register("e10_price_bounds", TX + RULES_CTE + """
SELECT property_type, is_valid AND NOT coalesce(actual_worth < lo OR actual_worth > hi, false) AS is_valid, count(*) AS records
FROM all_tx LEFT JOIN rules ON kind = property_type GROUP BY ALL""")
def e10(spark, sf):
    df = tables.all_transactions(spark, sf, "type").withColumn("trans_group_en", F.lit("Sales"))
    out = ingest.apply_price_bounds(df, SAMPLE_RULES, kind="property_type")
    return out.groupBy("property_type", "is_valid").agg(F.count(F.lit(1)).alias("records"))


@register("e11_year_month", """
WITH t AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN strftime(l_shipdate, '%d.%m.%Y') WHEN l_linenumber % 4 = 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)
SELECT coalesce(CAST(year(try_cast(d AS TIMESTAMP)) AS INTEGER), -1) AS transaction_year,
  coalesce(CAST(month(try_cast(d AS TIMESTAMP)) AS INTEGER), -1) AS transaction_month, count(*) AS records FROM t GROUP BY ALL""")
def e11(spark, sf):
    day, kind = F.col("l_shipdate"), F.col("l_linenumber") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "dd.MM.yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    df = ingest.with_year_month(tables.table(spark, sf, "lineitem").select(text.alias("instance_date")))
    keys = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("transaction_year", "transaction_month")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


PRICE_VERDICT = """CASE WHEN kind IS NULL THEN 'unknown type' WHEN actual_worth < lo THEN 'too low' WHEN actual_worth > hi THEN 'too high'
  WHEN actual_worth < warn_lo THEN 'unusually low' WHEN actual_worth > warn_hi THEN 'unusually high' ELSE 'ok' END"""
PRICE_SCORE = """CASE WHEN kind IS NULL THEN 0.7 WHEN actual_worth < lo OR actual_worth > hi THEN 0.0
  WHEN actual_worth < warn_lo OR actual_worth > warn_hi THEN 0.6 ELSE 1.0 END"""


@register("e12_sale_price_verdict", TX + RULES_CTE + f"""
SELECT transaction_id, property_type, {PRICE_VERDICT} AS verdict, {PRICE_SCORE} AS score, {PRICE_SCORE} > 0 AS is_valid
FROM all_tx LEFT JOIN rules ON kind = property_type""", r6="score")
def e12(spark, sf):
    df = tables.all_transactions(spark, sf, "type")
    verdict = ingest.price_verdict(F.col("actual_worth"), F.col("property_type"), SAMPLE_RULES)
    return df.select("transaction_id", "property_type", verdict.alias("v")).select("transaction_id", "property_type", "v.*")


SQM_SCORE = """CASE WHEN meter_sale_price < 950 OR meter_sale_price > 2050 THEN 0.0
  WHEN meter_sale_price < 1000 OR meter_sale_price > 2000 THEN 0.6 ELSE 1.0 END"""


@register("e13_price_per_sqm_verdict", TX + f"""
SELECT {SQM_SCORE} AS score, count(*) AS records, min(meter_sale_price) AS lowest, max(meter_sale_price) AS highest
FROM all_tx GROUP BY 1""", r6="score lowest highest")
def e13(spark, sf):
    df = tables.all_transactions(spark, sf, "type")
    score = ingest.sqm_verdict(F.col("meter_sale_price"), SAMPLE_SQM)["score"]
    return df.groupBy(score.alias("score")).agg(
        F.count(F.lit(1)).alias("records"), F.min("meter_sale_price").alias("lowest"), F.max("meter_sale_price").alias("highest")
    )


@register("e14_composite_quality", TX + RULES_CTE + f""", scored AS (
  SELECT transaction_id, {PRICE_SCORE} AS p, {SQM_SCORE} AS s, CASE WHEN transaction_year NOT BETWEEN 1996 AND 2000 THEN 0.0 ELSE 1.0 END AS y
  FROM all_tx LEFT JOIN rules ON kind = property_type)
SELECT transaction_id, CASE WHEN p = 0 OR s = 0 OR y = 0 THEN 0.0 ELSE (p + s + y + 1.0) / 4 END AS quality FROM scored""", r6="quality")
def e14(spark, sf):
    df = tables.all_transactions(spark, sf, "area", "type").withColumns(
        {
            "trans_group_en": F.lit("Sales"),
            "property_type_en": F.col("property_type"),
            "instance_date": F.date_format("instance_date", "dd-MM-yyyy"),
        }
    )
    quality = ingest.composite_quality(SAMPLE_RULES, (1996, 2000), SAMPLE_SQM)
    return df.select("transaction_id", quality.alias("quality"))


@register("e15_deduplicate", """
SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS instance_date, l_extendedprice AS actual_worth
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_shipdate AS DATE) DESC, l_extendedprice DESC) = 1""")
def e15(spark, sf):
    raw = tables.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").cast("date").alias("instance_date"),
        F.col("l_extendedprice").alias("actual_worth"),
    )
    return ingest.deduplicate(raw).withColumn("instance_date", F.col("instance_date").cast("string"))


@register("e16_load_summary", TX + """
SELECT count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS invalid_records,
  count(*) FILTER (is_valid AND is_luxury) AS luxury_records, count(DISTINCT area_name_en) AS unique_areas,
  CAST(min(instance_date) AS VARCHAR) AS earliest_date, CAST(max(instance_date) AS VARCHAR) AS latest_date,
  avg(actual_worth) FILTER (is_valid) AS avg_valid_price FROM all_tx""", r4="avg_valid_price")
def e16(spark, sf):
    df = ingest.load_summary(tables.all_transactions(spark, sf, "area"))
    return df.withColumns({c: F.col(c).cast("string") for c in ("earliest_date", "latest_date")})


SCORED = TX + RULES_CTE + f", scored AS (SELECT *, {PRICE_SCORE} AS score FROM all_tx LEFT JOIN rules ON kind = property_type)"


def _scored(spark, sf):
    df = tables.all_transactions(spark, sf, "type")
    verdict = ingest.price_verdict(F.col("actual_worth"), F.col("property_type"), SAMPLE_RULES)
    return df.withColumns({"quality_score": verdict["score"], "is_valid": verdict["is_valid"]})


@register("e34_quality_bands", SCORED + """
SELECT CASE WHEN score >= 1 THEN 'Excellent' WHEN score >= 0.7 THEN 'Good' WHEN score >= 0.5 THEN 'Fair' ELSE 'Poor' END AS quality_band,
  count(*) AS records FROM scored GROUP BY 1""")
def e34(spark, sf):
    return ingest.quality_bands(_scored(spark, sf))


@register("e35_invalid_sample", SCORED + """
SELECT transaction_id, property_type, actual_worth FROM scored WHERE score = 0 ORDER BY transaction_id LIMIT 50""")
def e35(spark, sf):
    return ingest.invalid_sample(_scored(spark, sf)).select("transaction_id", "property_type", "actual_worth")
