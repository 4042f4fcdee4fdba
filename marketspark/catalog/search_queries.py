"""Registered queries: search performance and page content."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketspark.catalog.registry import register
from marketspark.operators import search
from marketspark.sources import driver_tables as tables
from marketspark.sources.readers import picked_search_rows

LAUNCH = date(2024, 1, 16)

SR = r"""
WITH wd AS (SELECT p_partkey % 8 AS slot, arg_min(p_name, p_partkey) AS word FROM part GROUP BY 1),
pg AS (SELECT '/p/' || page_id AS page, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS meta_description,
  array_to_string(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ' ') AS h1, array_to_string(regexp_extract_all(html, '(?s)<h2[^>]*>(.*?)</h2>', 1), ' ') AS h2,
  regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS content FROM pages),
cn AS (SELECT CAST(ts AS DATE) AS date, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pk, user_id % 8 AS slot, count(*) FILTER (event_type <> 'click') AS impressions,
  count(*) FILTER (event_type = 'click') AS rc FROM events GROUP BY 1, 2, 3),
sr AS (SELECT date, '/p/' || pk AS page, CASE WHEN cn.slot < 4 OR title IS NULL THEN word WHEN cn.slot < 6 THEN string_split(lower(title), ' ')[1] || ' ' || word
    ELSE string_split(lower(title), ' ')[1] || ' ' || coalesce(string_split(lower(title), ' ')[2], '') || ' ' || word END AS query,
  impressions, CASE WHEN pk % 3 = 0 THEN 0 ELSE least(rc, impressions) END AS clicks, CAST(1 + (pk * 3 + cn.slot * 5) % 34 AS DOUBLE) + day(date) / 64 AS position
  FROM cn JOIN wd USING (slot) LEFT JOIN pg ON pg.page = '/p/' || pk WHERE impressions > 0)
"""
TOTALS = """CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr,
  sum(position * impressions) / sum(impressions) AS position"""
CTR = "CASE CAST(least(floor(position), 10) AS INTEGER) WHEN 1 THEN 0.28 WHEN 2 THEN 0.15 WHEN 3 THEN 0.11 WHEN 4 THEN 0.08 WHEN 5 THEN 0.06 WHEN 6 THEN 0.05 WHEN 7 THEN 0.04 WHEN 8 THEN 0.03 WHEN 9 THEN 0.03 WHEN 10 THEN 0.02 ELSE 0.01 END::DOUBLE"
PQ = SR + f""", pq0 AS (SELECT page, query, {TOTALS} FROM sr GROUP BY 1, 2), pq1 AS (SELECT *, {CTR} AS expected_ctr FROM pq0),
pq AS (SELECT *, (CASE WHEN position < 5 THEN 0.3 WHEN position <= 20 THEN 1 - abs(position - 10) / 15 ELSE greatest(0.1, 1 - (position - 20) / 80) END * 0.4
  + least(1.0, greatest(0.0, expected_ctr - ctr) / expected_ctr) * 0.3 + least(1.0, impressions / 1000) * 0.3) * 100 AS opportunity_score FROM pq1)"""
PQ_ROUND = "ctr position expected_ctr opportunity_score"


def rows_of(spark, sf):
    return tables.search_rows(spark, sf)


def scored(spark, sf):
    return search.scored_queries(search.page_queries(rows_of(spark, sf)))


def covered(spark, sf):
    return search.with_coverage(scored(spark, sf), tables.page_content(spark, sf))


@register("s4_search_rows", SR + "SELECT * REPLACE (CAST(date AS VARCHAR) AS date), clicks::DOUBLE / impressions AS ctr FROM sr", r6="ctr position")
def s4(spark, sf):
    return rows_of(spark, sf).withColumn("date", F.col("date").cast("string"))


@register("s4_search_rows_of_pages", SR + "SELECT * REPLACE (CAST(date AS VARCHAR) AS date), clicks::DOUBLE / impressions AS ctr FROM sr WHERE contains(page, '7')", r6="ctr position")
def s4b(spark, sf):
    return picked_search_rows(rows_of(spark, sf), page_contains="7").withColumn("date", F.col("date").cast("string"))


@register("g1_page_performance", SR + f"SELECT page, {TOTALS} FROM sr GROUP BY 1", r6="ctr position")
def g1(spark, sf):
    return search.page_performance(rows_of(spark, sf))


@register("g2_site_totals", SR + f"SELECT {TOTALS} FROM sr", r6="ctr position")
def g2(spark, sf):
    return search.site_totals(rows_of(spark, sf))


def _leaders(section, limit):
    return f"""SELECT '{section}' AS section, {section} AS name, {TOTALS}, CAST(row_number() OVER (ORDER BY sum(clicks) DESC, sum(impressions) DESC, {section}) AS INTEGER) AS rank FROM sr GROUP BY 2 QUALIFY rank <= {limit}"""


@register("g2_site_leaders", SR + _leaders("page", 100) + " UNION ALL " + _leaders("query", 200), r6="ctr position")
def g2b(spark, sf):
    return search.site_leaders(rows_of(spark, sf))


@register("g3_competing_pages", PQ + """SELECT page, query, clicks, impressions, ctr, position, pages, row_number() OVER (PARTITION BY query ORDER BY clicks DESC, impressions DESC, page) AS page_rank
FROM pq JOIN (SELECT query, count(*) AS pages FROM pq GROUP BY 1 HAVING count(*) >= 2) USING (query)""", r6="ctr position")
def g3(spark, sf):
    return search.competing_pages(search.page_queries(rows_of(spark, sf)))


@register("g3_pages_for_query", PQ + f"SELECT page, {TOTALS} FROM pq WHERE contains(query, 'old') GROUP BY 1 ORDER BY clicks DESC, impressions DESC, page LIMIT 50", r6="ctr position")
def g3b(spark, sf):
    return search.pages_for_query(search.page_queries(rows_of(spark, sf)), "old")


@register("g4_expected_ctr", PQ + "SELECT page, query, position, expected_ctr FROM pq", r6="position expected_ctr")
def g4(spark, sf):
    return scored(spark, sf).select("page", "query", "position", "expected_ctr")


@register("g5_opportunity_score", PQ + "SELECT * FROM pq", r6=PQ_ROUND)
def g5(spark, sf):
    return scored(spark, sf)


LISTS = {
    "top": ("true", 20, "impressions DESC, query"),
    # The score is compared after rounding, so that equal scores fall to the name on both sides.
    "opportunity": ("true", 20, "round(opportunity_score, 9) DESC, query"),
    "low_ctr": ("ctr < expected_ctr * 0.7 AND impressions >= 10", 15, "impressions DESC, query"),
    "near_ranking": ("position BETWEEN 11 AND 30 AND impressions >= 5", 15, "clicks DESC, impressions DESC, query"),
}


def _list(name):
    condition, limit, order = LISTS[name]
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY {order}) AS INTEGER) AS query_rank FROM pq WHERE {condition} QUALIFY query_rank <= {limit}"


@register("g6_query_shortlists", PQ + " UNION ALL ".join(f"SELECT '{n}' AS shortlist, * FROM ({_list(n)})" for n in LISTS), r6=PQ_ROUND)
def g6(spark, sf):
    return search.query_shortlists(scored(spark, sf))


@register("g7_page_queries", PQ + "SELECT page, query, clicks, impressions, ctr, position FROM pq", r6="ctr position")
def g7(spark, sf):
    return search.page_queries(rows_of(spark, sf))


@register("g7_nested_queries", PQ + "SELECT page, 0 AS part, count(*) AS queries, array_to_string(list(query || '=' || clicks || '/' || impressions ORDER BY clicks DESC, impressions DESC, query), '; ') AS query_list FROM pq GROUP BY 1")
def g7b(spark, sf):
    df = search.nested_queries(search.page_queries(rows_of(spark, sf)))
    shown = F.transform("query_list", lambda s: F.concat(s["query"], F.lit("="), s["clicks"].cast("string"), F.lit("/"), s["impressions"].cast("string")))
    return df.select("page", "part", "queries", F.array_join(shown, "; ").alias("query_list"))


def _cover(text, words):
    return f"coalesce(len(list_filter({words}, lambda w: contains({text}, w)))::DOUBLE / nullif(len({words}), 0), 0)"


COVER = PQ + f""", tw AS (SELECT pq.*, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '') AS tw, coalesce(lower(title), '') AS t, coalesce(lower(h1), '') AS a, coalesce(lower(h2), '') AS b,
  coalesce(lower(content), '') AS c, coalesce(meta_description, '') AS md, title FROM pq LEFT JOIN pg USING (page)),
cw AS (SELECT *, list_distinct(tw) AS dw FROM tw),
cv AS (SELECT * EXCLUDE (tw, dw, t, a, b, c, md, title), {_cover("t", "dw")} AS title_match, {_cover("a", "dw")} AS h1_match, {_cover("b", "dw")} AS h2_match, {_cover("c", "dw")} AS content_match,
  {_cover("c", "tw")} AS term_match FROM cw),
gp0 AS (SELECT *, CASE WHEN content_match < 0.5 THEN 'missing_section' WHEN title_match < 0.3 AND impressions >= 20 THEN 'title_mismatch' WHEN h2_match < 0.3 THEN 'weak_coverage'
    WHEN ctr < expected_ctr * 0.6 THEN 'meta_mismatch' END AS gap_type, CASE WHEN position > 3 THEN CAST(trunc((0.11 - ctr) * impressions) AS BIGINT) ELSE 0 END AS potential_clicks FROM cv WHERE impressions >= 5),
gp1 AS (SELECT *, CASE gap_type WHEN 'missing_section' THEN CASE WHEN impressions >= 50 THEN 'high' ELSE 'medium' END WHEN 'title_mismatch' THEN CASE WHEN position <= 10 THEN 'high' ELSE 'medium' END
    WHEN 'weak_coverage' THEN 'medium' ELSE CASE WHEN impressions >= 30 THEN 'high' ELSE 'low' END END AS priority FROM gp0 WHERE gap_type IS NOT NULL),
gp AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY list_position(['high', 'medium', 'low'], priority), potential_clicks DESC, query) AS INTEGER) AS gap_rank FROM gp1 QUALIFY gap_rank <= 20),
tq AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY impressions DESC, query) AS qr FROM cv QUALIFY qr <= 20),
nr AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY clicks DESC, impressions DESC, query) AS qr FROM cv WHERE position BETWEEN 11 AND 30 AND impressions >= 5 QUALIFY qr <= 15)"""
COVER_ROUND = PQ_ROUND + " title_match h1_match h2_match content_match term_match"


def gaps(spark, sf):
    return search.content_gaps(covered(spark, sf))


@register("s4_page_content", SR + "SELECT page, title, h1, h2, length(content) AS content_length FROM pg")
def page_content(spark, sf):
    return tables.page_content(spark, sf).select("page", "title", "h1", "h2", F.length("content").alias("content_length").cast("long"))


@register("g8_query_coverage", COVER + "SELECT * FROM cv", r6=COVER_ROUND)
def g8a(spark, sf):
    return covered(spark, sf)


@register("g8_content_gaps", COVER + "SELECT page, query, gap_type, priority, potential_clicks, gap_rank FROM gp")
def g8(spark, sf):
    return gaps(spark, sf).select("page", "query", "gap_type", "priority", "potential_clicks", "gap_rank")


@register("g9_content_scores", COVER + """, qc AS (SELECT page, count(*) FILTER (term_match >= 0.6) * 100.0::DOUBLE / count(*) AS query_coverage FROM tq GROUP BY 1),
qw AS (SELECT page, list_distinct(flatten(list(regexp_split_to_array(lower(query), '\\s+')))) AS qws FROM tq WHERE qr <= 5 GROUP BY 1),
ia AS (SELECT qw.page, CASE WHEN title IS NULL THEN 0.0 ELSE least(100.0, len(list_filter(list_intersect(list_distinct(regexp_split_to_array(lower(title), '\\s+')), qws),
  lambda w: w NOT IN ('in', 'the', 'a', 'for', 'and', 'or', 'to', 'of'))) * 20.0) END AS intent_alignment FROM qw LEFT JOIN pg ON pg.page = qw.page),
ce AS (SELECT page, least(100.0, sum(clicks) / sum(expected_ctr * impressions) * 100) AS ctr_efficiency FROM cv GROUP BY 1),
oi AS (SELECT page, least(100.0, coalesce((SELECT count(*) FROM gp WHERE gp.page = ce.page AND priority = 'high'), 0) * 5.0 + coalesce((SELECT count(*) FROM nr WHERE nr.page = ce.page), 0) * 3.0) AS opportunity_index FROM ce)
SELECT *, query_coverage * 0.30 + intent_alignment * 0.25 + ctr_efficiency * 0.25 + (100 - opportunity_index) * 0.20 AS overall
FROM qc JOIN ia USING (page) JOIN ce USING (page) JOIN oi USING (page)""", r6="query_coverage intent_alignment ctr_efficiency opportunity_index overall")
def g9(spark, sf):
    table = covered(spark, sf)
    return search.content_scores(table, tables.page_content(spark, sf), search.content_gaps(table))


ADVICE = """, ld AS (SELECT page, list_distinct(flatten(list(regexp_split_to_array(lower(query), '\\s+')))) AS ws, min(query) FILTER (qr = 1) AS top_query FROM tq WHERE qr <= 5 GROUP BY 1),
lc AS (SELECT page, least(15, count(*)) AS low_ctr_queries FROM cv WHERE ctr < expected_ctr * 0.7 AND impressions >= 10 GROUP BY 1),
ad AS (SELECT page, array_to_string(list_sort(list_filter(ws, lambda w: length(w) > 3 AND NOT contains(lower(title), w)))[1:3], ', ') AS missing_themes, length(title) > 60 AS title_too_long,
  length(title) < 30 AS title_too_short, NOT contains(lower(title), lower(top_query)) AS top_query_absent, length(meta_description) > 160 AS description_too_long,
  length(meta_description) < 120 AS description_too_short, NOT regexp_matches(lower(meta_description), 'discover|explore|find|learn|get|start|view') AS no_call_to_action,
  coalesce(low_ctr_queries, 0) AS low_ctr_queries FROM pg JOIN ld USING (page) LEFT JOIN lc USING (page))"""


@register("g10_page_advice", COVER + ADVICE + "SELECT * FROM ad")
def g10(spark, sf):
    return search.page_advice(scored(spark, sf), tables.page_content(spark, sf))


@register("g11_gap_rollup", COVER + """, gl AS (SELECT *, row_number() OVER (PARTITION BY page, gap_type ORDER BY gap_rank) AS place FROM gp QUALIFY place <= 5)
SELECT page, gap_type, array_to_string(list(query ORDER BY place), ', ') AS queries, CAST(sum(potential_clicks) AS BIGINT) AS potential FROM gl GROUP BY 1, 2
UNION ALL SELECT page, 'near_first_page', array_to_string(list(query ORDER BY qr), ', '), CAST(sum(impressions) AS BIGINT) FROM nr WHERE qr <= 10 GROUP BY 1""")
def g11(spark, sf):
    table = covered(spark, sf)
    return search.gap_rollup(search.content_gaps(table), table)


OPPORTUNE = """SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY round(opportunity_score, 9) DESC, query) AS INTEGER) AS query_rank FROM cv QUALIFY query_rank <= {0}"""


@register("g12_keyword_opportunities", COVER + f"""SELECT page, query, query_rank, opportunity_score, term_match, CASE WHEN term_match >= 0.5 THEN 'Strengthen' ELSE 'Add content for' END AS action
FROM ({OPPORTUNE.format(15)})""", r6="opportunity_score term_match")
def g12(spark, sf):
    return search.keyword_opportunities(covered(spark, sf))


@register("g13_quick_wins", COVER + """SELECT page, query, position, impressions, 'small push' AS win FROM (SELECT * FROM cv WHERE position BETWEEN 8 AND 12 AND impressions >= 10
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY clicks DESC, impressions DESC, query) = 1)
UNION ALL SELECT page, query, position, impressions, 'add heading' FROM (SELECT * FROM gp WHERE gap_type = 'weak_coverage' AND impressions >= 10 QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap_rank) = 1)""",
          r6="position")
def g13(spark, sf):
    table = covered(spark, sf)
    return search.quick_wins(table, search.content_gaps(table), min_impressions=10)


AREA_OPPS = f""", nm AS (SELECT DISTINCT p_name AS name FROM part),
ao AS (SELECT page, query, query_rank, min(name) AS name, impressions, position, CAST(trunc(impressions * 0.05) AS BIGINT) AS potential_clicks
  FROM ({OPPORTUNE.format(10)}) JOIN nm ON contains(' ' || array_to_string(list_filter(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}_#]+'), lambda w: w <> ''), ' ') || ' ', ' ' || name || ' ') GROUP BY ALL)"""


def opportunities(spark, sf, table):
    names = tables.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return search.area_opportunities(table, names, "name")


@register("g14_area_opportunities", COVER + AREA_OPPS + "SELECT * FROM ao", r6="position")
def g14(spark, sf):
    return opportunities(spark, sf, scored(spark, sf))


@register("g15_impact_estimates", COVER + ADVICE + AREA_OPPS + """, ge AS (SELECT page, sum(CASE WHEN gap_type IN ('missing_section', 'weak_coverage') THEN potential_clicks ELSE 0 END) AS gc, count(*) AS gn FROM gp WHERE gap_rank <= 10 GROUP BY 1),
ar AS (SELECT page, sum(potential_clicks) AS ac, count(*) AS an FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY query_rank) AS place FROM ao QUALIFY place <= 5) GROUP BY 1),
ac AS (SELECT page, CAST(missing_themes <> '' AS INTEGER) + CAST(title_too_long OR title_too_short AS INTEGER) + CAST(top_query_absent AS INTEGER) + CAST(low_ctr_queries > 0 AS INTEGER)
  + CAST(description_too_long OR description_too_short AS INTEGER) + CAST(no_call_to_action AS INTEGER) AS dn FROM ad),
im AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS current_clicks, CAST(sum(impressions) AS BIGINT) AS current_impressions FROM cv GROUP BY 1),
pt AS (SELECT page, current_clicks, current_impressions, CAST(coalesce(gc, 0) + coalesce(ac.ac, 0) AS BIGINT) AS potential_clicks, CAST(coalesce(gn, 0) + coalesce(an, 0) + coalesce(dn, 0) AS BIGINT) AS changes
  FROM im LEFT JOIN ge USING (page) LEFT JOIN ar ac USING (page) LEFT JOIN ac dd USING (page))
SELECT *, potential_clicks * 100.0::DOUBLE / greatest(current_clicks, 1) AS projected_improvement_pct, CASE WHEN changes <= 5 THEN 'low' WHEN changes <= 15 THEN 'medium' ELSE 'high' END AS effort FROM pt""",
          r6="projected_improvement_pct")
def g15(spark, sf):
    table = covered(spark, sf)
    content = tables.page_content(spark, sf)
    return search.impact_estimates(
        table, search.content_gaps(table), search.page_advice(table, content), opportunities(spark, sf, table)
    )


SIDES = SR + f""", sd AS (SELECT CASE WHEN date < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS period, {TOTALS}, count(DISTINCT date) AS days FROM sr GROUP BY 1),
rt AS (SELECT *, clicks::DOUBLE / days AS clicks_per_day, impressions::DOUBLE / days AS impressions_per_day FROM sd)"""


@register("g16_before_after", SIDES + "SELECT *, (after - before) / nullif(before, 0) * 100 AS change_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, max({m}::DOUBLE) FILTER (period = 'before') AS before, max({m}::DOUBLE) FILTER (period = 'after') AS after FROM rt"
    for m in ("clicks", "impressions", "ctr", "position", "clicks_per_day", "impressions_per_day")) + ")", r6="before after change_pct")
def g16(spark, sf):
    return search.before_after(rows_of(spark, sf), LAUNCH)


@register("g17_query_cohorts", SR + f""", b AS (SELECT query, {TOTALS} FROM sr WHERE date < DATE '2024-01-16' GROUP BY 1), a AS (SELECT query, {TOTALS} FROM sr WHERE date >= DATE '2024-01-16' GROUP BY 1)
SELECT query, coalesce(b.clicks, -1) AS clicks_before, coalesce(b.impressions, -1) AS impressions_before, b.ctr AS ctr_before, b.position AS position_before,
  coalesce(a.clicks, -1) AS clicks_after, coalesce(a.impressions, -1) AS impressions_after, a.ctr AS ctr_after, a.position AS position_after, a.position - b.position AS position_delta,
  CASE WHEN b.query IS NULL THEN 'new' WHEN a.query IS NULL THEN 'lost' WHEN a.position - b.position > 2 THEN 'worsened' ELSE 'common' END AS cohort
FROM b FULL JOIN a USING (query)""", r6="ctr_before position_before ctr_after position_after position_delta")
def g17(spark, sf):
    return search.query_cohorts(rows_of(spark, sf), LAUNCH).fillna(
        -1, subset=["clicks_before", "impressions_before", "clicks_after", "impressions_after"]
    )
