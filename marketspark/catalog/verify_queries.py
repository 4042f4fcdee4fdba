"""Registered queries: verification of numbers and of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.intelligence_queries import YEARS, _study_sql
from marketspark.catalog.metric_queries import M1, M3
from marketspark.catalog.registry import TX, register
from marketspark.functions.lineage import shared
from marketspark.operators import claims, metrics, opportunities, verify
from marketspark.sources import driver_tables as tables

# Claims as published numbers would be: per area and quarter of 2000, per half-year of the whole market,
# per month and type, and per year; some of them off by a little, some by much.
CLAIM_SETS = (
    ("quarterly", "area_name_en", "NULL", "quarter(instance_date)"),
    ("semi_annual", "NULL", "NULL", "(month(instance_date) - 1) // 6 + 1"),
    ("monthly", "NULL", "property_type", "month(instance_date)"),
    ("annual", "area_name_en", "property_type", "1"),
    ("semi_annual", "area_name_en", "NULL", "(month(instance_date) - 1) // 6 + 2"),
)


def _claim_sql(i, kind, area, ptype, number):
    return f"""SELECT {i} || '/' || coalesce(a, '') || '/' || coalesce(t, '') || '/' || num AS claim_id, CAST(2000 AS INTEGER) AS year, '{kind}' AS period_type, num AS period_num, a AS area, t AS property_type,
    n + CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END AS transaction_count, v * CASE WHEN n % 4 = 0 THEN 1.05 ELSE 1.001 END AS total_volume,
    v / n * CASE WHEN n % 3 = 0 THEN 1.02 ELSE 1.0005 END AS avg_price, o AS offplan_count, o * 100.0::DOUBLE / n + CASE WHEN n % 7 = 0 THEN 5 ELSE 0 END AS offplan_percentage,
    l AS luxury_count, l * 100.0::DOUBLE / n AS luxury_percentage
  FROM (SELECT CAST({area} AS VARCHAR) AS a, CAST({ptype} AS VARCHAR) AS t, CAST({number} AS INTEGER) AS num, count(*) AS n, sum(actual_worth) AS v,
    count(*) FILTER (transaction_type = 'Off-Plan') AS o, count(*) FILTER (is_luxury) AS l FROM tx WHERE transaction_year = 2000 GROUP BY 1, 2, 3)"""


CLAIMS = TX + ", cl AS (" + " UNION ALL ".join(_claim_sql(i, *c) for i, c in enumerate(CLAIM_SETS)) + """),
per AS (SELECT *, CASE period_type WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 WHEN 'semi_annual' THEN 6 ELSE 12 END AS mp FROM cl),
fx AS (SELECT claim_id, count(*) AS c, sum(actual_worth) AS v FROM per JOIN tx ON transaction_year = year AND transaction_month > (period_num - 1) * mp AND transaction_month <= period_num * mp
  AND (area IS NULL OR area = area_name_en) AND (per.property_type IS NULL OR per.property_type = tx.property_type) GROUP BY 1),
pf AS (SELECT claim_id, min(transaction_year) AS y0, max(transaction_year) AS y1, min(transaction_month) AS m0, max(transaction_month) AS m1, count(DISTINCT transaction_month) AS mc
  FROM per JOIN (SELECT DISTINCT transaction_year, transaction_month FROM tx) d ON d.transaction_year * 12 + transaction_month - 1 >= year * 12 + (period_num - 1) * mp
    AND d.transaction_year * 12 + transaction_month - 1 < year * 12 + period_num * mp GROUP BY 1),
k AS (SELECT per.*, coalesce(c, 0) AS rc, coalesce(v, 0) AS rv, y0, y1, m0, m1, mc, period_num BETWEEN 1 AND 12 // mp AS ok FROM per LEFT JOIN fx USING (claim_id) LEFT JOIN pf USING (claim_id)),
ck AS (
  SELECT claim_id, 'transaction_count' AS test_name, CASE WHEN NOT ok THEN 'ERROR' WHEN transaction_count = e THEN 'PASS' ELSE 'FAIL' END AS status, e AS expected_value, transaction_count::DOUBLE AS actual_value, '' AS detail
    FROM (SELECT *, CASE WHEN ok THEN rc END::DOUBLE AS e FROM k)
  UNION ALL SELECT claim_id, 'total_volume', CASE WHEN NOT ok THEN 'ERROR' WHEN abs((total_volume - e) / e) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, e, total_volume, ''
    FROM (SELECT *, CASE WHEN ok THEN rv END AS e FROM k)
  UNION ALL SELECT claim_id, 'avg_price', CASE WHEN NOT ok THEN 'ERROR' WHEN abs((avg_price - e) / e) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, e, avg_price, ''
    FROM (SELECT *, CASE WHEN ok THEN rv / rc END AS e FROM k)
  UNION ALL SELECT claim_id, 'offplan_pct', CASE WHEN e = 0 THEN CASE WHEN abs(offplan_percentage) <= 0.01 THEN 'PASS' ELSE 'FAIL' END WHEN abs((offplan_percentage - e) / e) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, e, offplan_percentage, ''
    FROM (SELECT *, offplan_count * 100.0::DOUBLE / transaction_count AS e FROM k)
  UNION ALL SELECT claim_id, 'luxury_pct', CASE WHEN e = 0 THEN CASE WHEN abs(luxury_percentage) <= 0.01 THEN 'PASS' ELSE 'FAIL' END WHEN abs((luxury_percentage - e) / e) <= 0.01 THEN 'PASS' ELSE 'FAIL' END, e, luxury_percentage, ''
    FROM (SELECT *, luxury_count * 100.0::DOUBLE / transaction_count AS e FROM k)
  UNION ALL SELECT claim_id, 'period_boundaries', CASE WHEN period_type NOT IN ('quarterly', 'semi_annual') THEN 'SKIPPED' WHEN NOT ok THEN 'FAIL' WHEN m0 > (period_num - 1) * mp AND m1 <= period_num * mp THEN 'PASS' ELSE 'FAIL' END, NULL, NULL,
    CASE WHEN period_type NOT IN ('quarterly', 'semi_annual') THEN 'not checked' WHEN NOT ok THEN 'invalid period number' ELSE 'months ' || m0 || '-' || m1 || ' (' || mc || ' distinct)' END FROM k
  UNION ALL SELECT claim_id, 'date_range', CASE WHEN NOT ok THEN 'ERROR' WHEN y0 = year AND y1 = year THEN 'PASS' ELSE 'FAIL' END, NULL, NULL, CASE WHEN ok THEN 'years ' || y0 || '-' || y1 ELSE 'invalid period number' END FROM k),
checks AS (SELECT *, actual_value - expected_value AS deviation,
  CASE WHEN expected_value IS NULL THEN NULL WHEN expected_value <> 0 THEN (actual_value - expected_value) / abs(expected_value) * 100 WHEN actual_value = 0 THEN 0.0 ELSE 'inf'::DOUBLE END AS deviation_pct FROM ck)
"""
CHECK_ROUND = {"r4": "expected_value actual_value deviation deviation_pct"}


def _claims(spark, sf):
    sales = tables.transactions(spark, sf, "area", "type").where("transaction_year = 2000")
    # Months per area and type first; the claims of every kind are added up from these.
    cells = sales.groupBy("area_name_en", "property_type", "transaction_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual_worth").alias("v"),
        F.count_if(F.col("transaction_type") == "Off-Plan").alias("o"), F.count_if("is_luxury").alias("l"),
    )
    month = F.col("transaction_month") - 1
    half = F.floor(month / 6)
    numbers = (F.floor(month / 3) + 1, half + 1, month + 1, F.lit(1), half + 2)
    out = None
    for i, ((kind, area, ptype, _), number) in enumerate(zip(CLAIM_SETS, numbers)):
        a = F.col("area_name_en") if area != "NULL" else F.lit(None).cast("string")
        t = F.col("property_type") if ptype != "NULL" else F.lit(None).cast("string")
        g = cells.groupBy(a.alias("area"), t.alias("ptype"), number.cast("int").alias("period_num")).agg(
            *[F.sum(c).alias(c) for c in ("n", "v", "o", "l")]
        )
        n = F.col("n")
        blank = F.lit("")
        part = g.select(
            F.concat_ws("/", F.lit(str(i)), F.coalesce("area", blank), F.coalesce("ptype", blank), F.col("period_num").cast("string")).alias("claim_id"),
            F.lit(2000).alias("year"), F.lit(kind).alias("period_type"), "period_num", "area", F.col("ptype").alias("property_type"),
            (n + F.when(n % 5 == 0, 2).otherwise(0)).alias("transaction_count"),
            (F.col("v") * F.when(n % 4 == 0, 1.05).otherwise(1.001)).alias("total_volume"),
            (F.col("v") / n * F.when(n % 3 == 0, 1.02).otherwise(1.0005)).alias("avg_price"),
            F.col("o").alias("offplan_count"),
            (F.col("o") * 100.0 / n + F.when(n % 7 == 0, 5).otherwise(0)).alias("offplan_percentage"),
            F.col("l").alias("luxury_count"), (F.col("l") * 100.0 / n).alias("luxury_percentage"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _placed(spark, sf):
    sales = tables.transactions(spark, sf, "area", "type")
    return verify.with_facts(_claims(spark, sf), verify.period_facts(sales))


def _checks(spark, sf):
    return verify.run_checks(_claims(spark, sf), tables.transactions(spark, sf, "area", "type"))


def _blank(df):
    return df.withColumn("detail", F.coalesce("detail", F.lit("")))


def _check_query(name, test, build_check):
    @register(name, CLAIMS + f"SELECT * FROM checks WHERE test_name = '{test}'", **CHECK_ROUND)
    def build(spark, sf):
        return _blank(build_check(_placed(spark, sf)))

    return build


_check_query("v1_transaction_count", "transaction_count", verify.check_count)
_check_query("v2_total_volume", "total_volume", verify.check_volume)
_check_query("v3_average_price", "avg_price", verify.check_average_price)
_check_query("v4_percentage", "offplan_pct",
             lambda p: verify.check_percentage(p, "offplan_count", "transaction_count", "offplan_percentage", "offplan_pct"))
_check_query("v5_period_boundaries", "period_boundaries", verify.check_period_boundaries)
_check_query("v6_date_range", "date_range", verify.check_date_range)


@register("v7_status_summary", CLAIMS + """SELECT count(*) AS total_tests, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'PASS') AS pass,
  count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / count(*) AS pass_rate FROM checks WHERE status <> 'SKIPPED'""", r6="pass_rate")
def v7(spark, sf):
    return verify.status_summary(_checks(spark, sf))


@register("v8_metric_cross_check", TX + f""", m AS ({M1}), old AS (SELECT area_name_en, total_transactions + CASE WHEN total_transactions % 6 = 0 THEN 1 ELSE 0 END AS total_transactions, avg_price FROM m)
SELECT old.*, actual_count, actual_avg, CASE WHEN total_transactions = actual_count THEN 'PASS' ELSE 'FAIL' END AS status
FROM old JOIN (SELECT area_name_en, count(*) AS actual_count, avg(actual_worth) AS actual_avg FROM tx GROUP BY 1) USING (area_name_en)""", r4="avg_price actual_avg")
def v8(spark, sf):
    sales = tables.transactions(spark, sf, "area", "developer", "project", "type")
    n = F.col("total_transactions")
    stale = metrics.area_metrics(sales).withColumn("total_transactions", n + F.when(n % 6 == 0, 1).otherwise(0))
    return verify.cross_check(stale, sales)


BENCHMARK = TX + """, b AS (SELECT area_name_en, transaction_year AS year, count(*) + CASE WHEN count(*) % 6 = 0 THEN 3 ELSE 0 END AS verified FROM tx WHERE transaction_year >= 1999 GROUP BY 1, 2
  UNION ALL SELECT r_name, 2000, 10 FROM region),
rc AS (SELECT b.*, coalesce(c, 0) AS current, coalesce(c, 0) - verified AS difference, (coalesce(c, 0) - verified) * 100.0::DOUBLE / verified AS difference_pct,
  CASE WHEN b.area_name_en NOT IN (SELECT area_name_en FROM tx) THEN 'MISSING_FROM_DATABASE' WHEN coalesce(c, 0) = verified THEN 'MATCH' ELSE 'COUNT_MISMATCH' END AS status
  FROM b LEFT JOIN (SELECT area_name_en, transaction_year AS year, count(*) AS c FROM tx GROUP BY 1, 2) USING (area_name_en, year))"""


def _reconciled(spark, sf):
    sales = tables.transactions(spark, sf, "area")
    n = F.count(F.lit(1))
    known = sales.where("transaction_year >= 1999").groupBy("area_name_en", F.col("transaction_year").alias("year")).agg(
        (n + F.when(n % 6 == 0, 3).otherwise(0)).alias("verified")
    )
    unknown = tables.table(spark, sf, "region").select(F.col("r_name").alias("area_name_en"), F.lit(2000).alias("year"), F.lit(10).cast("long").alias("verified"))
    return verify.reconcile(known.unionByName(unknown), sales)


@register("v9_benchmark_reconciliation", BENCHMARK + "SELECT * FROM rc", r6="difference_pct")
def v9(spark, sf):
    return _reconciled(spark, sf)


@register("v9_match_rates", BENCHMARK + """SELECT year, count(*) AS areas, count(*) FILTER (status = 'MATCH') AS matching, count(*) FILTER (status = 'MATCH') * 100.0::DOUBLE / count(*) AS match_rate_pct
FROM rc GROUP BY 1""", r6="match_rate_pct")
def v9b(spark, sf):
    return verify.match_rates(_reconciled(spark, sf))


LOOSE = ("avg_value_1", "avg_value_2", "avg_value_3", "growth_2_pct", "growth_3_pct", "compound_growth_pct")
EXACT = ("transactions_1", "transactions_2", "transactions_3", "change_2", "change_3", "change_total")
REVALIDATION = TX + _study_sql("area_name_en") + """, pub AS (SELECT * REPLACE (transactions_2 + CASE WHEN transactions_2 % 4 = 0 THEN 1 ELSE 0 END AS transactions_2,
  growth_3_pct * CASE WHEN transactions_1 % 3 = 0 THEN 1.2 ELSE 1 END AS growth_3_pct) FROM study),
lg AS (""" + " UNION ALL ".join(
    f"SELECT p.name, '{c}' AS \"check\", p.{c}::DOUBLE AS expected, s.{c}::DOUBLE AS actual, {0.0 if c in EXACT else 0.01} AS tol FROM pub p JOIN study s USING (name)" for c in (*EXACT, *LOOSE)) + """),
rv AS (SELECT name, "check", expected, actual, CASE WHEN expected = 0 OR actual = 0 OR expected = 999999 OR actual = 999999 THEN expected = actual
  ELSE abs(expected - actual) <= greatest(abs(expected), abs(actual)) * tol END AS passed FROM lg)"""


def _revalidated(spark, sf):
    sales = tables.transactions(spark, sf, "area")
    study = opportunities.growth_study(sales, "area_name_en", YEARS)
    n2 = F.col("transactions_2")
    published = study.withColumns(
        {
            "transactions_2": n2 + F.when(n2 % 4 == 0, 1).otherwise(0),
            "growth_3_pct": F.col("growth_3_pct") * F.when(F.col("transactions_1") % 3 == 0, 1.2).otherwise(1.0),
        }
    )
    return verify.revalidate_study(published, sales, "area_name_en", YEARS)


@register("v10_study_revalidation", REVALIDATION + "SELECT * FROM rv", r4="expected actual")
def v10(spark, sf):
    return _revalidated(spark, sf)


@register("v10_study_quality", REVALIDATION + "SELECT count(*) AS checks, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) * 100.0::DOUBLE / count(*) AS quality_score FROM rv", r6="quality_score")
def v10b(spark, sf):
    return verify.study_quality(_revalidated(spark, sf))


@register("v11_deviations", TX + """, y AS (SELECT area_name_en, count(*) FILTER (transaction_year = 1999 AND is_luxury AND rooms_en = '1 B/R') AS expected, count(*) FILTER (transaction_year = 2000 AND is_luxury AND rooms_en = '1 B/R') AS actual FROM tx GROUP BY 1)
SELECT *, actual - expected AS deviation, CASE WHEN expected <> 0 THEN (actual - expected)::DOUBLE / abs(expected) * 100 WHEN actual = 0 THEN 0.0 ELSE 'inf'::DOUBLE END AS deviation_pct,
  CASE WHEN expected = 0 THEN abs(actual) <= 0.25 ELSE abs((actual - expected)::DOUBLE / expected) <= 0.25 END AS within_tolerance FROM y""", r4="deviation_pct")
def v11(spark, sf):
    wanted = F.col("is_luxury") & (F.col("rooms_en") == "1 B/R")
    counted = tables.transactions(spark, sf, "area", "rooms").groupBy("area_name_en").agg(
        F.count_if((F.col("transaction_year") == 1999) & wanted).alias("expected"), F.count_if((F.col("transaction_year") == 2000) & wanted).alias("actual")
    )
    return counted.select(
        "*", verify.deviation("expected", "actual").alias("deviation"), verify.deviation_pct("expected", "actual").alias("deviation_pct"),
        verify.matches("expected", "actual", 0.25).alias("within_tolerance"),
    )


@register("v12_report_table", CLAIMS + "SELECT *, CAST(list_position(['FAIL', 'ERROR', 'PASS', 'SKIPPED'], status) AS INTEGER) AS status_order FROM checks WHERE status <> 'SKIPPED'", **CHECK_ROUND)
def v12(spark, sf):
    return _blank(verify.report_table(_checks(spark, sf)))


REPORTS = TX + r""", g AS (SELECT area_name_en AS a, transaction_year AS y, count(*) AS n, avg(actual_worth) AS mean, min(actual_worth) AS low, max(actual_worth) AS high, avg(meter_sale_price) AS sqm,
  count(*) FILTER (is_luxury) AS lux, min(developer) AS dev, max(project_name_en) AS proj, CAST(regexp_extract(area_name_en, '(\d+)$', 1) AS INTEGER) AS num FROM tx GROUP BY 1, 2, 11),
docs AS (SELECT a || '/' || y AS doc_id, CASE WHEN num % 3 = 0 THEN 'area_guide_' || lower(a) || '.md' ELSE 'page.md' END AS file_name,
  CASE WHEN num % 2 = 0 THEN 'area: ' || a || chr(10) ELSE '' END || CASE WHEN num % 4 <> 1 THEN '# ' || a || ' Real Estate in 20' || (y % 15 + 10) || chr(10) ELSE '' END
  || 'The average price was AED ' || format('{:,}', CAST(floor(CASE WHEN (num + y) % 3 = 0 THEN mean * 1.5 ELSE mean END) AS BIGINT)) || ' for ' || format('{:,}', n) || ' transactions, from aed '
  || format('{:,}', CAST(floor(low) AS BIGINT)) || ' to AED ' || format('{:,}', CAST(floor(high) AS BIGINT)) || '.' || chr(10) || 'Homes cost AED ' || format('{:,}', CAST(floor(sqm) AS BIGINT)) || ' per sqm; '
  || format('{:,}', lux) || ' units were luxury, or ' || CAST(floor(lux * 100 / n) AS BIGINT) || '.5% of all, on plots of ' || format('{:,}', n * 37) || ' sqm.' || chr(10)
  || CASE WHEN num % 5 = 0 THEN 'Prices are expected to rise. ' ELSE '' END || 'Leading seller: ' || dev || ', best project: ' || proj || '.' AS text FROM g),
named AS (SELECT *, coalesce(nullif(trim(regexp_extract(text, '(?m)^area:[ \t]*([^\r\n]+)$', 1)), ''),
  nullif(CASE WHEN file_name LIKE 'area_guide_%' THEN 'Nation ' || regexp_extract(file_name, 'nation_(\d+)', 1) ELSE '' END, ''),
  nullif(trim(regexp_extract(text, '(?m)^#[ \t]+([^\r\n]+?)[ \t]+Real Estate', 1)), '')) AS subject FROM docs)"""


def _reports(spark, sf, sales=None):
    docs = tables.area_reports(spark, sf, sales)
    return docs.withColumn("subject", claims.subject("text", "file_name"))


def _values(pattern):
    return f"list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda m: try_cast(replace(m, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL)"


CURRENCY = r"(?i)AED\s*([\d,]+(?:\.\d+)?)"
COUNTED = r"(?i)(\d{1,3}(?:,\d{3})*)\s*(?:transactions?|properties|units|sales)"
PERCENT = r"([\d.]+)%"


def _extract_sql(source):
    return " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, CAST(u.i - 1 AS INTEGER) AS position, vals[u.i] AS value FROM (SELECT doc_id, {_values(p)} AS vals FROM {source}), unnest(range(1, len(vals) + 1)) u(i)"""
        for kind, p in (("currency", CURRENCY), ("count", COUNTED), ("percentage", PERCENT)))


@register("x1_extracted_numbers", REPORTS + _extract_sql("named"))
def x1(spark, sf):
    return claims.extracted_numbers(_reports(spark, sf))


@register("x1_extracted_numbers_documents", _extract_sql("documents"))
def x1b(spark, sf):
    return claims.extracted_numbers(tables.table(spark, sf, "documents").select("doc_id", "text"))


FIGURES = {
    "price": CURRENCY, "percentage": r"([\d.]+)\s*%", "count": r"(?i)([\d,]+)\s+(?:transactions?|units?|properties|sales)",
    "area": r"(?i)([\d,]+(?:\.\d+)?)\s*(?:sqm|sq\.?\s*m)",
}


@register("x2_figures", REPORTS + " UNION ".join(
    f"SELECT doc_id, '{k}' AS kind, unnest({_values(p)}) AS value FROM named" for k, p in FIGURES.items()))
def x2(spark, sf):
    return claims.figures(_reports(spark, sf)).where("kind <> 'large_number'").select("doc_id", "kind", "value")


def _placed_sql(kind, pattern):
    """Matches of a pattern with their places: the pieces between matches and the matches before add up to them."""
    bare = pattern.replace(r"(?<![.\d])", "").replace(r"(?![.\d%])", "")
    quoted = bare.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, text, i, whole[i] AS w, raw[i] AS r,
  CAST(1 + list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS place
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}', 0) AS whole, regexp_extract_all(text, '{quoted}', 1) AS raw,
    regexp_split_to_array(text, '{quoted}') AS pieces FROM documents))"""


# Without look-around, the neighbours of a number without a unit are tested by their characters.
FIGURE_PLACES = "WITH m AS (" + " UNION ALL ".join(_placed_sql(k, p) for k, p in claims.FIGURE_PATTERNS.items()) + r"""),
f AS (SELECT doc_id, kind, i, r AS raw, TRY_CAST(replace(r, ',', '') AS DOUBLE) AS value,
  trim(replace(substr(text, greatest(1, place - 50), least(50, place - 1)) || w || substr(text, place + length(w), 50), chr(10), ' ')) AS context FROM m
  WHERE kind <> 'large_number' OR NOT (regexp_matches(substr(text, greatest(1, place - 1), least(1, place - 1)), '[.0-9]') OR regexp_matches(substr(text, place + length(w), 1), '[.0-9%]')))
SELECT doc_id, kind, value, arg_min(raw, i) AS raw, arg_min(context, i) AS context FROM f WHERE value IS NOT NULL GROUP BY doc_id, kind, value"""


@register("x2_figures_with_context", FIGURE_PLACES)
def x2b(spark, sf):
    return claims.figures(tables.table(spark, sf, "documents").select("doc_id", "text"))


@register("x4_subjects", REPORTS + "SELECT doc_id, coalesce(subject, '') AS subject FROM named")
def x4(spark, sf):
    return _reports(spark, sf).select("doc_id", F.coalesce("subject", F.lit("")).alias("subject"))


@register("x5_content_issues", REPORTS + """, t AS (SELECT doc_id, subject, text FROM named UNION ALL SELECT CAST(doc_id AS VARCHAR), source, text FROM documents)
SELECT doc_id, array_to_string(list_filter(['expected to', 'projected to', 'will likely', 'is expected', 'according to experts', 'industry sources', 'it is believed', 'forecast', 'prediction'],
  lambda p: contains(lower(text), p)), ', ') AS phrases, coalesce(contains(lower(text), lower(subject)), false) AS names_subject FROM t""")
def x5(spark, sf):
    own = _reports(spark, sf).select("doc_id", "subject", "text")
    given = tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("subject"), "text")
    out = claims.content_issues(own.unionByName(given))
    return out.select("doc_id", F.array_join("phrases", ", ").alias("phrases"), "names_subject")


@register("x6_mentions", REPORTS + """, nm AS (SELECT s_name AS name FROM supplier UNION SELECT p_name FROM part UNION SELECT n_name FROM nation),
pad AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_#]+'), lambda w: w <> ''), '  ') || ' ' AS w FROM docs)
SELECT doc_id, name, CAST((length(w) - length(replace(w, ' ' || replace(lower(name), ' ', '  ') || ' ', ''))) // (length(name) + 2 + length(name) - length(replace(name, ' ', ''))) AS BIGINT) AS mentions
FROM pad JOIN nm ON contains(w, ' ' || replace(lower(name), ' ', '  ') || ' ')""")
def x6(spark, sf):
    names = None
    for table, c in (("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name")):
        part = tables.table(spark, sf, table).select(F.col(c).alias("name"))
        names = part if names is None else names.unionByName(part)
    return claims.mentions(_reports(spark, sf), names.distinct(), "name")


@register("x7_stale_years", REPORTS + r""", t AS (SELECT doc_id, text FROM named UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents),
o AS (SELECT doc_id, list_min(list_transform(regexp_extract_all(text, '\b(20[12][0-9])\b', 1), lambda y: CAST(y AS INTEGER))) AS oldest_year FROM t)
SELECT * FROM o WHERE oldest_year < 2018""")
def x7(spark, sf):
    own = _reports(spark, sf).select("doc_id", "text")
    given = tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = own.unionByName(given).select("doc_id", claims.stale_year("text", 2019).alias("oldest_year"))
    return out.where(F.col("oldest_year").isNotNull())


FACTS = f""", m1 AS ({M1}), m3 AS ({M3}),
m5 AS (SELECT area_name_en, property_type, rooms_en, count(*) AS c, avg(actual_worth) AS p, row_number() OVER (PARTITION BY area_name_en ORDER BY count(*) DESC, property_type, rooms_en) AS place
  FROM tx GROUP BY 1, 2, 3 HAVING count(*) >= 5),
mom AS (SELECT area_name_en, transaction_year AS y, transaction_month AS m, property_type AS t, (avg_price - lag(avg_price) OVER w) / lag(avg_price) OVER w * 100 AS ch FROM m3
  WINDOW w AS (PARTITION BY area_name_en, property_type ORDER BY transaction_year, transaction_month)),
facts AS (SELECT area_name_en, total_transactions, avg_price, median_price, min_price, max_price, avg_price_sqm, avg_size_sqm, luxury_count, total_transactions AS actual_transaction_count,
  (SELECT list(p ORDER BY place) FROM m5 WHERE m5.area_name_en = m1.area_name_en AND place <= 5) AS room_prices,
  (SELECT arg_max(ch, (y, m, t)) FROM mom WHERE ch IS NOT NULL AND mom.area_name_en = m1.area_name_en) AS recent_mom_change FROM m1)"""


def _facts(df):
    return claims.area_facts(
        metrics.area_metrics(df), df, metrics.property_type_metrics(df), metrics.month_over_month(metrics.monthly_trends(df))
    )


@register("x8_area_facts", TX + FACTS + "SELECT * REPLACE (array_to_string(list_transform(room_prices, lambda p: CAST(p AS DECIMAL(12, 1))), ', ') AS room_prices) FROM facts",
          r6="avg_price_sqm avg_size_sqm recent_mom_change", r4="avg_price median_price")
def x8(spark, sf):
    shown = F.transform("room_prices", lambda p: p.cast("decimal(12,1)").cast("string"))
    return _facts(shared(tables.transactions(spark, sf))).withColumn("room_prices", F.array_join(shown, ", "))


def _near(values, fact, tolerance):
    return f"coalesce(len(list_filter({values}, lambda v: CASE WHEN {fact} = 0 THEN v = 0 ELSE abs((v - {fact}) / {fact} * 100) <= {tolerance} END)) > 0, false)"


CHECKED = REPORTS + FACTS + f""", nv AS (SELECT doc_id, subject, {_values(CURRENCY)} AS cv, {_values(COUNTED)} AS nn, {_values(PERCENT)} AS pv FROM named),
jf AS (SELECT * FROM nv JOIN facts ON subject = area_name_en),
cx AS (
  SELECT doc_id, subject, 'avg_price' AS "check", CASE WHEN {_near("cv", "avg_price", 2)} THEN 'OK' ELSE 'ERROR' END AS status FROM jf
  UNION ALL SELECT doc_id, subject, 'median_price', CASE WHEN {_near("cv", "median_price", 2)} THEN 'OK' ELSE 'WARNING' END FROM jf
  UNION ALL SELECT doc_id, subject, 'avg_price_sqm', CASE WHEN {_near("cv", "avg_price_sqm", 2)} THEN 'OK' ELSE 'ERROR' END FROM jf
  UNION ALL SELECT doc_id, subject, 'transaction_count', CASE WHEN {_near("nn", "actual_transaction_count", 5)} THEN 'OK' ELSE 'WARNING' END FROM jf
  UNION ALL SELECT doc_id, subject, 'price_range', CASE WHEN {_near("cv", "min_price", 5)} AND {_near("cv", "max_price", 5)} THEN 'OK' ELSE 'WARNING' END FROM jf
  UNION ALL SELECT doc_id, subject, 'luxury_count', CASE WHEN luxury_count > 0 THEN CASE WHEN {_near("nn", "luxury_count", 10)} THEN 'OK' ELSE 'WARNING' END END FROM jf
  UNION ALL SELECT doc_id, subject, 'room_prices', CASE WHEN len(list_filter(room_prices[1:3], lambda p: len(list_filter(cv, lambda v: abs((v - p) / p * 100) <= 5)) > 0)) > 0 THEN 'OK' END FROM jf
  UNION ALL SELECT doc_id, subject, 'price_change', CASE WHEN len(list_filter(pv, lambda v: abs(abs(v) - abs(recent_mom_change)) < 1)) > 0 THEN 'OK' END FROM jf),
cz AS (SELECT * FROM cx WHERE status IS NOT NULL)"""


def _checked(spark, sf):
    sales = shared(tables.transactions(spark, sf))
    return claims.checked_claims(_reports(spark, sf, sales), _facts(sales))


@register("x3_checked_claims", CHECKED + "SELECT * FROM cz")
def x3(spark, sf):
    return _checked(spark, sf)


@register("x3_document_verdicts", CHECKED + """SELECT doc_id, subject, count(*) FILTER (status = 'OK') AS checks_passed, count(*) FILTER (status = 'WARNING') AS warnings,
  count(*) FILTER (status = 'ERROR') AS errors, count(*) FILTER (status = 'ERROR') = 0 AS is_valid FROM cz GROUP BY 1, 2""")
def x3b(spark, sf):
    return claims.document_verdicts(_checked(spark, sf))


def _present(fact):
    return f"CAST(len(list_filter(cv, lambda v: abs(floor({fact}) - floor(v)) < floor({fact}) * 0.01)) > 0 AS INTEGER)"


@register("x9_minimum_evidence", CHECKED + f"""SELECT doc_id, subject, {_present("avg_price")} + {_present("median_price")} + {_present("avg_price_sqm")} AS facts_found,
  {_present("avg_price")} + {_present("median_price")} + {_present("avg_price_sqm")} >= 2 AS has_evidence FROM jf""")
def x9(spark, sf):
    sales = shared(tables.transactions(spark, sf))
    return claims.minimum_evidence(_reports(spark, sf, sales), _facts(sales))
