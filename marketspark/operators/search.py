"""Search performance of pages against their text.

Daily rows are added up to one row per page and query first; every list per page is cut by row number,
a filter Spark also applies before the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import CALL_TO_ACTION_WORDS, EXPECTED_CTR, OTHER_CTR, TITLE_STOP_WORDS
from marketspark.functions.expr import pct_change, ratio, rows
from marketspark.functions.scale import ordered_members
from marketspark.operators.claims import mentions
from marketspark.operators.metrics import numbered

# Click-through rate assumed for a page moved up to position 3, and for a newly covered area.
TARGET_CTR = EXPECTED_CTR[3]
NEW_AREA_CTR = 0.05
PRIORITIES = ("high", "medium", "low")


def _totals() -> list[Column]:
    weighted = F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions"))
    return [
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.coalesce(ratio(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("ctr"),
        F.coalesce(weighted, F.lit(0.0)).alias("position"),
    ]


def page_queries(search_rows: DataFrame) -> DataFrame:
    """One row per page and query."""
    return search_rows.groupBy("page", "query").agg(*_totals())


def page_performance(search_rows: DataFrame) -> DataFrame:
    """Clicks, impressions, click-through rate and impression-weighted position of every page."""
    return search_rows.groupBy("page").agg(*_totals())


def site_totals(search_rows: DataFrame) -> DataFrame:
    return search_rows.agg(*_totals())


def site_leaders(search_rows: DataFrame, pages: int = 100, queries: int = 200) -> DataFrame:
    """The pages and the queries with most clicks."""
    out = None
    for section, limit in (("page", pages), ("query", queries)):
        order = (F.desc("clicks"), F.desc("impressions"), F.col("name"))
        grouped = search_rows.groupBy(F.col(section).alias("name")).agg(*_totals()).orderBy(*order).limit(limit)
        part = numbered(grouped, *order).withColumn("section", F.lit(section))
        out = part if out is None else out.unionByName(part)
    return out


def competing_pages(per_query: DataFrame, min_pages: int = 2) -> DataFrame:
    """Pages that answer the same query, best first, for every query with more than one."""
    counts = per_query.groupBy("query").agg(rows().alias("pages")).where(F.col("pages") >= min_pages)
    # A query may be answered by most pages of a site, so its pages are ranked in parts.
    return ordered_members(per_query.join(counts, "query"), ["query"], "clicks", F.desc("impressions"), "page", rank="page_rank")


def pages_for_query(per_query: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Pages found for queries that contain a text."""
    matching = per_query.where(F.contains(F.col("query"), F.lit(text)))
    return page_performance(matching).orderBy(F.desc("clicks"), F.desc("impressions"), "page").limit(limit)


def expected_ctr(position: Column | str) -> Column:
    """Expected click-through rate of a position: a step table up to 10, the value of 10 beyond it."""
    place = F.least(F.floor(position), F.lit(10)).cast("int")
    table = F.create_map(*[F.lit(x) for item in EXPECTED_CTR.items() for x in item])
    return F.coalesce(table[place], F.lit(OTHER_CTR))


def opportunity_score() -> Column:
    """How much a query could gain: position 40%, click-through gap 30%, volume 30%; 0 to 100."""
    position, ctr = F.col("position"), F.col("ctr")
    place = (
        F.when(position < 5, 0.3)
        .when(position <= 20, 1.0 - F.abs(position - 10) / 15)
        .otherwise(F.greatest(F.lit(0.1), 1.0 - (position - 20) / 80))
    )
    expected = expected_ctr("position")
    gap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), expected - ctr) / expected)
    volume = F.least(F.lit(1.0), F.col("impressions") / 1000)
    return (place * 0.4 + gap * 0.3 + volume * 0.3) * 100


def scored_queries(per_query: DataFrame) -> DataFrame:
    return per_query.withColumns({"expected_ctr": expected_ctr("position"), "opportunity_score": opportunity_score()})


def _ranked(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    window = Window.partitionBy("page").orderBy(*order)
    return df.withColumn("query_rank", F.row_number().over(window)).where(F.col("query_rank") <= limit)


def top_queries(scored: DataFrame, limit: int = 20) -> DataFrame:
    return _ranked(scored, limit, F.desc("impressions"), "query")


def opportunity_queries(scored: DataFrame, limit: int = 20) -> DataFrame:
    # Rounded, so that equal scores fall to the name whatever the order of summation.
    return _ranked(scored, limit, F.desc(F.round("opportunity_score", 9)), "query")


def low_ctr_queries(scored: DataFrame, limit: int = 15) -> DataFrame:
    low = (F.col("ctr") < F.col("expected_ctr") * 0.7) & (F.col("impressions") >= 10)
    return _ranked(scored.where(low), limit, F.desc("impressions"), "query")


def near_ranking_queries(scored: DataFrame, limit: int = 15) -> DataFrame:
    near = F.col("position").between(11, 30) & (F.col("impressions") >= 5)
    return _ranked(scored.where(near), limit, F.desc("clicks"), F.desc("impressions"), "query")


def query_shortlists(scored: DataFrame) -> DataFrame:
    """The four shortlists of every page as one table."""
    lists = {
        "top": top_queries, "opportunity": opportunity_queries, "low_ctr": low_ctr_queries, "near_ranking": near_ranking_queries,
    }
    out = None
    for name, pick in lists.items():
        part = pick(scored).withColumn("shortlist", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def nested_queries(per_query: DataFrame, limit: int = 500) -> DataFrame:
    """Queries of every page as lists, most clicked first.

    A list holds up to `limit` queries; a page with more has further parts (part 0, 1, ...), so every query is in a
    list and no task gathers one of unknown length.
    """
    counts = per_query.groupBy("page").agg(rows().alias("queries"))
    placed = ordered_members(per_query, ["page"], "clicks", F.desc("impressions"), "query", rank="query_rank")
    entry = F.struct("query_rank", "query", "clicks", "impressions", "ctr", "position")
    part = F.floor((F.col("query_rank") - 1) / limit).cast("int").alias("part")
    lists = placed.groupBy("page", part).agg(F.array_sort(F.collect_list(entry)).alias("query_list"))
    return counts.join(lists, "page")


def _coverage(text: str, terms: str) -> Column:
    """Share of words contained in a lower-case text, as parts of words too."""
    hits = F.size(F.filter(terms, lambda w: F.contains(F.col(text), w)))
    return F.coalesce(hits / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0))


def with_coverage(scored: DataFrame, content: DataFrame) -> DataFrame:
    """Queries next to how far title, headings and text of their page cover their words.

    Texts are lowered once per page; coverage is taken in the row, so texts do not move again.
    """
    lowered = content.select(
        "page",
        *[F.lower(F.coalesce(c, F.lit(""))).alias(f"__{c}") for c in ("title", "h1", "h2", "content")],
    )
    empty = {f"__{c}": "" for c in ("title", "h1", "h2", "content")}
    joined = scored.join(lowered, "page", "left").fillna(empty)
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    worded = joined.withColumns({"__terms": terms, "__distinct": F.array_distinct(terms)})
    return worded.select(
        *scored.columns,
        _coverage("__title", "__distinct").alias("title_match"),
        _coverage("__h1", "__distinct").alias("h1_match"),
        _coverage("__h2", "__distinct").alias("h2_match"),
        _coverage("__content", "__distinct").alias("content_match"),
        _coverage("__content", "__terms").alias("term_match"),
    )


def content_gaps(covered: DataFrame, limit: int = 20, min_impressions: int = 5) -> DataFrame:
    """Queries a page answers poorly, by kind of gap, the most valuable first."""
    impressions, position = F.col("impressions"), F.col("position")
    missing = F.col("content_match") < 0.5
    title = (F.col("title_match") < 0.3) & (impressions >= 20)
    heading = F.col("h2_match") < 0.3
    snippet = F.col("ctr") < F.col("expected_ctr") * 0.6
    kind = F.when(missing, "missing_section").when(title, "title_mismatch").when(heading, "weak_coverage").when(snippet, "meta_mismatch")
    priority = (
        F.when(missing, F.when(impressions >= 50, "high").otherwise("medium"))
        .when(title, F.when(position <= 10, "high").otherwise("medium"))
        .when(heading, "medium")
        .when(snippet, F.when(impressions >= 30, "high").otherwise("low"))
    )
    gain = F.when(position > 3, ((F.lit(TARGET_CTR) - F.col("ctr")) * impressions).cast("long")).otherwise(F.lit(0).cast("long"))
    found = (
        covered.where(impressions >= min_impressions)
        .withColumns({"gap_type": kind, "priority": priority, "potential_clicks": gain})
        .where(F.col("gap_type").isNotNull())
    )
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    window = Window.partitionBy("page").orderBy(order, F.desc("potential_clicks"), "query")
    return found.withColumn("gap_rank", F.row_number().over(window)).where(F.col("gap_rank") <= limit)


def content_scores(covered: DataFrame, content: DataFrame, gaps: DataFrame) -> DataFrame:
    """Coverage, intent, click-through efficiency, open potential and overall score of every page."""
    top = top_queries(covered)
    coverage = top.groupBy("page").agg((F.count_if(F.col("term_match") >= 0.6) / rows() * 100).alias("query_coverage"))
    stop = F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])
    # At most five queries per page, so their words are few.
    leading = top.where(F.col("query_rank") <= 5).groupBy("page").agg(
        F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("query"), r"\s+")))).alias("query_words")
    )
    titles = content.select("page", F.array_distinct(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+")).alias("title_words"))
    common = F.size(F.array_except(F.array_intersect("title_words", "query_words"), stop))
    intent = leading.join(titles, "page", "left").select(
        "page", F.least(F.lit(100.0), F.coalesce(F.when(F.col("title_words").isNotNull(), common), F.lit(0)) * 20.0).alias("intent_alignment")
    )
    clicks = covered.groupBy("page").agg(
        F.sum("clicks").alias("clicks"), F.sum(F.col("expected_ctr") * F.col("impressions")).alias("expected_clicks")
    )
    high = gaps.groupBy("page").agg(F.count_if(F.col("priority") == "high").alias("high_gaps"))
    near = near_ranking_queries(covered).groupBy("page").agg(rows().alias("near_ranking"))
    table = (
        clicks.join(coverage, "page", "left").join(intent, "page", "left").join(high, "page", "left").join(near, "page", "left")
        .fillna({"high_gaps": 0, "near_ranking": 0, "intent_alignment": 0.0, "query_coverage": 50.0})
    )
    efficiency = F.least(F.lit(100.0), F.coalesce(ratio("clicks", "expected_clicks") * 100, F.lit(50.0)))
    table = table.withColumns(
        {
            "ctr_efficiency": efficiency,
            "opportunity_index": F.least(F.lit(100.0), (F.col("high_gaps") * 5 + F.col("near_ranking") * 3).cast("double")),
        }
    )
    overall = (
        F.col("query_coverage") * 0.30 + F.col("intent_alignment") * 0.25 + F.col("ctr_efficiency") * 0.25
        + (100 - F.col("opportunity_index")) * 0.20
    )
    return table.select(
        "page", "query_coverage", "intent_alignment", "ctr_efficiency", "opportunity_index", overall.alias("overall")
    )


def page_advice(scored: DataFrame, content: DataFrame) -> DataFrame:
    """What is wrong with title and description of every page, as facts."""
    lowered = F.lower(F.coalesce("title", F.lit("")))
    top = top_queries(scored, 10)
    # Five queries per page at most.
    leading = top.where(F.col("query_rank") <= 5).groupBy("page").agg(
        F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("query"), r"\s+")))).alias("words"),
        F.min(F.when(F.col("query_rank") == 1, F.col("query"))).alias("top_query"),
    )
    low = low_ctr_queries(scored).groupBy("page").agg(rows().alias("low_ctr_queries"))
    joined = content.join(leading, "page").join(low, "page", "left").withColumn("__title", lowered)
    absent = F.filter("words", lambda w: (F.length(w) > 3) & ~F.contains(F.col("__title"), w))
    meta = F.coalesce("meta_description", F.lit(""))
    calls = F.lit(False)
    for word in CALL_TO_ACTION_WORDS:
        calls = calls | F.contains(F.lower(meta), F.lit(word))
    return joined.select(
        "page",
        F.array_join(F.slice(F.array_sort(absent), 1, 3), ", ").alias("missing_themes"),
        (F.length("title") > 60).alias("title_too_long"),
        (F.length("title") < 30).alias("title_too_short"),
        (~F.contains(F.col("__title"), F.lower("top_query"))).alias("top_query_absent"),
        (F.length(meta) > 160).alias("description_too_long"),
        (F.length(meta) < 120).alias("description_too_short"),
        (~calls).alias("no_call_to_action"),
        F.coalesce("low_ctr_queries", F.lit(0)).alias("low_ctr_queries"),
    )


def gap_rollup(gaps: DataFrame, scored: DataFrame, per_kind: int = 5, near: int = 10) -> DataFrame:
    """Leading queries and their summed potential per page and kind of gap, and those near the first page."""
    order = Window.partitionBy("page", "gap_type").orderBy("gap_rank")
    leading = gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_kind)

    def listed(place: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "query"))), lambda s: s["query"]), ", ")

    kinds = leading.groupBy("page", "gap_type").agg(listed("place").alias("queries"), F.sum("potential_clicks").alias("potential"))
    ranked = near_ranking_queries(scored, near)
    close = ranked.groupBy("page").agg(listed("query_rank").alias("queries"), F.sum("impressions").alias("potential"))
    return kinds.unionByName(close.withColumn("gap_type", F.lit("near_first_page")))


def keyword_opportunities(covered: DataFrame, limit: int = 15) -> DataFrame:
    """Leading opportunity queries with how far the text covers them and what to do."""
    picked = opportunity_queries(covered, limit)
    action = F.when(F.col("term_match") >= 0.5, "Strengthen").otherwise("Add content for")
    return picked.select("page", "query", "query_rank", "opportunity_score", "term_match", action.alias("action"))


def quick_wins(scored: DataFrame, gaps: DataFrame, min_impressions: int = 30) -> DataFrame:
    """Per page the first query just short of the first page, and the first without a heading."""
    short = scored.where(F.col("position").between(8, 12) & (F.col("impressions") >= min_impressions))
    first = _ranked(short, 1, F.desc("clicks"), F.desc("impressions"), "query")
    window = Window.partitionBy("page").orderBy("gap_rank")
    heading = gaps.where((F.col("gap_type") == "weak_coverage") & (F.col("impressions") >= min_impressions))
    heading = heading.withColumn("place", F.row_number().over(window)).where("place = 1")
    columns = ("page", "query", "position", "impressions")
    return first.select(*columns, F.lit("small push").alias("win")).unionByName(
        heading.select(*columns, F.lit("add heading").alias("win"))
    )


def area_opportunities(scored: DataFrame, names: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Leading opportunity queries that mention a known name, with the clicks new content might bring."""
    picked = opportunity_queries(scored, limit)
    # Mentions are found once per distinct query, not once per page.
    queries = picked.select(F.col("query").alias("doc_id"), F.col("query").alias("text")).distinct()
    named = mentions(queries, names, name).groupBy("doc_id").agg(F.min(name).alias(name))
    return picked.join(named, F.col("query") == F.col("doc_id")).select(
        "page", "query", "query_rank", name, "impressions", "position",
        (F.col("impressions") * NEW_AREA_CTR).cast("long").alias("potential_clicks"),
    )


def impact_estimates(scored: DataFrame, gaps: DataFrame, advice: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Clicks a page might gain, and the effort by number of changes (up to 5 low, up to 15 medium)."""
    used = gaps.where(F.col("gap_rank") <= 10)
    from_text = F.col("gap_type").isin("missing_section", "weak_coverage")
    per_gap = used.groupBy("page").agg(
        F.sum(F.when(from_text, F.col("potential_clicks")).otherwise(0)).alias("gap_clicks"), rows().alias("gap_changes")
    )
    order = Window.partitionBy("page").orderBy("query_rank")
    areas = (
        opportunities.withColumn("place", F.row_number().over(order)).where("place <= 5").groupBy("page")
        .agg(F.sum("potential_clicks").alias("area_clicks"), rows().alias("area_changes"))
    )
    flags = [F.col("missing_themes") != "", F.col("title_too_long") | F.col("title_too_short"), F.col("top_query_absent"),
             F.col("low_ctr_queries") > 0, F.col("description_too_long") | F.col("description_too_short"), F.col("no_call_to_action")]
    advised = flags[0].cast("int")
    for flag in flags[1:]:
        advised = advised + flag.cast("int")
    counts = advice.select("page", advised.alias("advice_changes"))
    clicks = scored.groupBy("page").agg(F.sum("clicks").alias("current_clicks"), F.sum("impressions").alias("current_impressions"))
    joined = clicks.join(per_gap, "page", "left").join(areas, "page", "left").join(counts, "page", "left").fillna(
        0, subset=["gap_clicks", "gap_changes", "area_clicks", "area_changes", "advice_changes"]
    )
    changes = F.col("gap_changes") + F.col("area_changes") + F.col("advice_changes")
    potential = F.col("gap_clicks") + F.col("area_clicks")
    return joined.select(
        "page", "current_clicks", "current_impressions", potential.alias("potential_clicks"), changes.alias("changes"),
        (potential * 100.0 / F.greatest("current_clicks", F.lit(1))).alias("projected_improvement_pct"),
        F.when(changes <= 5, "low").when(changes <= 15, "medium").otherwise("high").alias("effort"),
    )


def before_after(search_rows: DataFrame, launch: date) -> DataFrame:
    """Totals and daily rates before and from a launch date on, with the change of each."""
    side = F.when(F.col("date") < F.lit(launch), "before").otherwise("after")
    totals = search_rows.groupBy(side.alias("period")).agg(*_totals(), F.countDistinct("date").alias("days"))
    rated = totals.withColumns(
        {"clicks_per_day": ratio("clicks", "days"), "impressions_per_day": ratio("impressions", "days")}
    )
    measures = ("clicks", "impressions", "ctr", "position", "clicks_per_day", "impressions_per_day")
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = rated.select("period", F.explode(pairs).alias("p"))
    return long.groupBy("p.measure").agg(
        F.max(F.when(F.col("period") == "before", F.col("p.value"))).alias("before"),
        F.max(F.when(F.col("period") == "after", F.col("p.value"))).alias("after"),
    ).withColumn("change_pct", pct_change("after", "before"))


def query_cohorts(search_rows: DataFrame, launch: date, worse_by: float = 2.0) -> DataFrame:
    """Queries seen before and after a launch (with their change of position), new ones and lost ones."""
    is_before = F.col("date") < F.lit(launch)

    def side(rows_of: DataFrame, suffix: str) -> DataFrame:
        totals = rows_of.groupBy("query").agg(*_totals())
        return totals.select("query", *[F.col(c).alias(f"{c}_{suffix}") for c in ("clicks", "impressions", "ctr", "position")])

    before, after = side(search_rows.where(is_before), "before"), side(search_rows.where(~is_before), "after")
    joined = before.join(after, "query", "full_outer")
    delta = F.col("position_after") - F.col("position_before")
    cohort = (
        F.when(F.col("position_before").isNull(), "new").when(F.col("position_after").isNull(), "lost")
        .when(delta > worse_by, "worsened").otherwise("common")
    )
    return joined.withColumns({"position_delta": delta, "cohort": cohort})
