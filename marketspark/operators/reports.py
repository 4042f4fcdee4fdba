"""Period reports, comparisons, rankings and segment drill-downs over clean sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.functions.expr import (
    avg_where, band, count_where, filled, pct_change, rank_of, ratio, rows, share, sum_where,
)
from marketspark.functions.periods import PER_YEAR, Period, calendar, period_columns, period_index
from marketspark.functions.scale import Quantile, join_on, summarise
from marketspark.operators.metrics import PRICE, SQM, mix, numbered, offplan, ready, with_total

SQFT_PER_SQM = 10.764

# Column that names an entity of each category.
CATEGORIES = {
    "areas": "area_name_en",
    "developers": "developer",
    "projects": "project_name_en",
    "property_types": "property_type",
}


def scoped(df: DataFrame, area: str | None = None, property_type: str | None = None) -> DataFrame:
    if area is not None:
        df = df.where(F.col("area_name_en") == area)
    return df if property_type is None else df.where(F.col("property_type") == property_type)


def period_measures(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The full set of period measures for each key, zero where there are no sales."""
    is_luxury = F.col("is_luxury")
    measured = summarise(
        df,
        list(keys),
        [
            rows().alias("total_transactions"),
            F.coalesce(F.sum(PRICE), F.lit(0.0)).alias("total_sales_volume"),
            F.avg(PRICE).alias("avg_price"),
            F.min(PRICE).alias("min_price"),
            F.max(PRICE).alias("max_price"),
            F.stddev_samp(PRICE).alias("price_stddev"),
            F.avg("procedure_area").alias("avg_size_sqm"),
            F.avg(SQM).alias("avg_price_per_sqm"),
            count_where(is_luxury).alias("luxury_count"),
            F.coalesce(sum_where(is_luxury, PRICE), F.lit(0.0)).alias("luxury_volume"),
            count_where(offplan()).alias("offplan_count"),
            F.coalesce(sum_where(offplan(), PRICE), F.lit(0.0)).alias("offplan_volume"),
            count_where(ready()).alias("ready_count"),
            F.coalesce(sum_where(ready(), PRICE), F.lit(0.0)).alias("ready_volume"),
        ],
        [
            Quantile("median_price", PRICE, 0.5),
            Quantile("price_q1", PRICE, 0.25),
            Quantile("price_q3", PRICE, 0.75),
            Quantile("median_price_per_sqm", SQM, 0.5),
        ],
        distinct={"unique_areas": "area_name_en", "unique_projects": "project_name_en", "unique_developers": "developer"},
    )
    return with_derived_measures(measured)


def with_derived_measures(measured: DataFrame) -> DataFrame:
    """Shares and averages per segment, price range, interquartile range and coefficient of variation."""
    zero = F.lit(0.0)
    derived = {
        "avg_transaction_size": F.coalesce(ratio("total_sales_volume", "total_transactions"), zero),
        "price_range": F.coalesce(F.col("max_price") - F.col("min_price"), zero),
        "price_iqr": F.coalesce(F.col("price_q3") - F.col("price_q1"), zero),
        "coefficient_of_variation": F.coalesce(share("price_stddev", "avg_price"), zero),
    }
    for segment in ("luxury", "offplan", "ready"):
        derived[f"{segment}_percentage"] = F.coalesce(share(f"{segment}_count", "total_transactions"), zero)
        derived[f"{segment}_avg_price"] = F.coalesce(ratio(f"{segment}_volume", f"{segment}_count"), zero)
    return measured.withColumns(derived)


def period_metrics(
    df: DataFrame, period: Period, area: str | None = None, property_type: str | None = None
) -> DataFrame:
    """One row of measures for one period, optionally of one area or property type."""
    return period_measures(scoped(df, area, property_type).where(period.contains()))


def type_distribution(df: DataFrame, period: Period, area: str | None = None) -> DataFrame:
    return mix(scoped(df, area).where(period.contains()), "property_type", "property_type")


def periods_of(df: DataFrame, kind: str) -> DataFrame:
    """Sales and volume per period with the period before and the same period one year earlier.

    Neighbours are found by period number, so an empty period reads as no sales, not as the last
    one that had any.
    """
    counted = df.groupBy(period_index("instance_date", kind).alias("period_index")).agg(
        rows().alias("tx_count"), F.sum(PRICE).alias("volume")
    )

    def shifted(by: int, prefix: str) -> DataFrame:
        return counted.select(
            (F.col("period_index") + by).alias("period_index"), F.col("tx_count").alias(f"{prefix}_tx_count")
        )

    out = counted.join(shifted(1, "previous"), "period_index", "left")
    out = out.join(shifted(PER_YEAR[kind], "year_before"), "period_index", "left")
    zero = F.lit(0)
    return out.select(
        "period_index",
        *period_columns("period_index", kind),
        "tx_count",
        "volume",
        F.coalesce("previous_tx_count", zero).alias("previous_tx_count"),
        F.coalesce("year_before_tx_count", zero).alias("year_before_tx_count"),
    )


COMPARED = (
    "total_transactions", "total_sales_volume", "avg_price", "median_price", "avg_price_per_sqm",
    "luxury_count", "offplan_count", "offplan_percentage",
)
COUNTED = ("total_transactions", "total_sales_volume", "luxury_count", "offplan_count", "offplan_percentage")


def period_comparison(
    df: DataFrame, period: Period, against: str = "mom", area: str | None = None, property_type: str | None = None
) -> DataFrame:
    """Measures of a period next to those of another, one row per measure; both from one scan.

    against: "mom" for the period before, "yoy" for the same period one year earlier.
    """
    if against not in ("mom", "yoy"):
        raise ValueError(f"unknown comparison: {against}")
    other = period.previous() if against == "mom" else period.year_before()
    either = scoped(df, area, property_type).where(period.contains() | other.contains())
    measured = period_measures(either.withColumn("is_current", period.contains()), ["is_current"])
    long = measured.select(
        "is_current",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in COMPARED])
        ).alias("m"),
    )
    paired = long.groupBy("m.measure").agg(
        F.max(F.when(F.col("is_current"), F.col("m.value"))).alias("current_value"),
        F.max(F.when(~F.col("is_current"), F.col("m.value"))).alias("previous_value"),
    )
    # A period without sales counts as 0; its averages stay unknown.
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in COMPARED])).alias("measure"))
    paired = every.join(paired, "measure", "left")
    counted = F.col("measure").isin(*COUNTED)
    paired = paired.withColumns({c: F.coalesce(c, F.when(counted, 0.0)) for c in ("current_value", "previous_value")})
    # A share is compared by difference only.
    change = F.when(F.col("measure") != "offplan_percentage", pct_change("current_value", "previous_value"))
    return paired.withColumns(
        {"absolute_change": F.col("current_value") - F.col("previous_value"), "percentage_change": change}
    )


def top_performers(
    df: DataFrame,
    period: Period,
    category: str = "areas",
    metric: str = "transaction_count",
    limit: int = 10,
    min_rows: int = 5,
) -> DataFrame:
    """The leading areas, developers, projects or property types of a period."""
    if metric not in ("transaction_count", "sales_volume", "avg_price"):
        raise ValueError(f"unknown metric: {metric}")
    name = CATEGORIES[category]
    ranked = summarise(
        df.where(period.contains() & filled(name)).withColumn("name", F.col(name)),
        ["name"],
        [
            rows().alias("transaction_count"),
            F.sum(PRICE).alias("sales_volume"),
            F.avg(PRICE).alias("avg_price"),
            F.avg(SQM).alias("avg_price_sqm"),
            count_where(F.col("is_luxury")).alias("luxury_count"),
            count_where(offplan()).alias("offplan_count"),
        ],
        [Quantile("median_price", PRICE, 0.5)],
        distinct={"unique_projects": "project_name_en"},
    ).where(F.col("transaction_count") >= min_rows)
    order = (F.desc(metric), F.col("name"))
    top = ranked.orderBy(*order).limit(limit)
    return numbered(top, *order).withColumns(
        {
            "luxury_percentage": share("luxury_count", "transaction_count"),
            "offplan_percentage": share("offplan_count", "transaction_count"),
        }
    )


def top_price_growth(
    df: DataFrame, period: Period, category: str = "areas", limit: int = 10, min_rows: int = 5
) -> DataFrame:
    """Largest growth of the average price against the period before; both periods from one scan."""
    name, now, before = CATEGORIES[category], period.contains(), period.previous().contains()
    grouped = (
        df.where((now | before) & filled(name))
        .groupBy(F.col(name).alias("name"))
        .agg(
            count_where(now).alias("current_count"),
            count_where(before).alias("previous_count"),
            avg_where(now, PRICE).alias("current_avg_price"),
            avg_where(before, PRICE).alias("previous_avg_price"),
        )
        .where((F.col("current_count") >= min_rows) & (F.col("previous_count") >= min_rows) & (F.col("previous_avg_price") > 0))
        .withColumns(
            {
                "price_growth_pct": pct_change("current_avg_price", "previous_avg_price"),
                "price_growth_abs": F.col("current_avg_price") - F.col("previous_avg_price"),
            }
        )
    )
    order = (F.desc("price_growth_pct"), F.col("name"))
    return numbered(grouped.drop("previous_count").orderBy(*order).limit(limit), *order)


def area_summaries(df: DataFrame, period: Period) -> DataFrame:
    """Period measures of every area in one job."""
    return period_measures(df.where(period.contains()), ["area_name_en"])


def area_top_projects(df: DataFrame, period: Period, limit: int = 10, min_rows: int = 3) -> DataFrame:
    """The leading projects of every area in one job."""
    order = Window.partitionBy("area_name_en").orderBy(F.desc("transaction_count"), "project_name_en", "developer")
    return (
        df.where(period.contains() & filled("project_name_en"))
        .groupBy("area_name_en", "project_name_en", "developer")
        .agg(
            rows().alias("transaction_count"),
            F.avg(PRICE).alias("avg_price"),
            F.avg(SQM).alias("avg_price_sqm"),
            count_where(offplan()).alias("offplan_count"),
        )
        .where(F.col("transaction_count") >= min_rows)
        .withColumn("offplan_percentage", share("offplan_count", "transaction_count"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def market_period_overview(df: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    """Leading areas, developers and projects of a period by number of sales, as sections."""
    sections = [
        top_performers(df, period, category, limit=limit).select(
            F.lit(category).alias("section"), "rank", "name", "transaction_count", "sales_volume", "avg_price"
        )
        for category in ("areas", "developers", "projects")
    ]
    return sections[0].unionByName(sections[1]).unionByName(sections[2])


def time_series(
    df: DataFrame, first: Period, last: Period, area: str | None = None, property_type: str | None = None
) -> DataFrame:
    """Measures of every period of a range from one grouped job, with a zero row for an empty one."""
    span = (F.col("instance_date") >= F.lit(first.start)) & (F.col("instance_date") < F.lit(last.end))
    sales = scoped(df, area, property_type).where(span)
    measured = period_measures(sales.withColumn("period_index", period_index("instance_date", first.kind)), ["period_index"])
    counts = ("total_transactions", "luxury_count", "offplan_count", "ready_count")
    volumes = ("total_sales_volume", "luxury_volume", "offplan_volume", "ready_volume")
    joined = calendar(df.sparkSession, first, last).join(measured, "period_index", "left")
    return joined.fillna(0, subset=list(counts)).fillna(0.0, subset=list(volumes))


def citation_statistics(df: DataFrame) -> DataFrame:
    """What an article about an area may cite: span of the data and how varied it is."""
    return summarise(
        df,
        ["area_name_en"],
        [
            rows().alias("total_analyzed"),
            F.min("instance_date").alias("earliest_date"),
            F.max("instance_date").alias("latest_date"),
            count_where(offplan()).alias("offplan_count"),
        ],
        distinct={"room_types": "rooms_en", "years_covered": "transaction_year", "developers_count": "developer"},
    )


def offplan_report(df: DataFrame, period: Period) -> DataFrame:
    """Off-plan measures of a period, the price gap to ready homes and the change to the period before."""
    now, before = period.contains(), period.previous().contains()
    current = summarise(
        df.where(now & offplan()),
        [],
        [
            rows().alias("total_offplan"),
            F.avg(PRICE).alias("avg_price"),
            F.min(PRICE).alias("min_price"),
            F.max(PRICE).alias("max_price"),
            F.sum(PRICE).alias("total_volume"),
            F.avg(SQM).alias("avg_price_sqm"),
            F.avg("procedure_area").alias("avg_size_sqm"),
            count_where(F.col("is_luxury")).alias("luxury_offplan"),
        ],
        [Quantile("median_price", PRICE, 0.5)],
        distinct={"areas": "area_name_en", "projects": "project_name_en", "developers": "developer"},
    )
    others = df.where(now | before).agg(
        count_where(now).alias("market_total"),
        count_where(now & ready()).alias("ready_count"),
        avg_where(now & ready(), PRICE).alias("ready_avg_price"),
        count_where(before & offplan()).alias("previous_offplan"),
        avg_where(before & offplan(), PRICE).alias("previous_avg_price"),
    )
    return join_on(current, others, []).withColumns(
        {
            "offplan_share": share("total_offplan", "market_total"),
            "gap_to_ready": F.col("avg_price") - F.col("ready_avg_price"),
            "gap_to_ready_pct": pct_change("avg_price", "ready_avg_price"),
            "transactions_change_pct": pct_change("total_offplan", "previous_offplan"),
            "price_change_pct": pct_change("avg_price", "previous_avg_price"),
        }
    )


def segment_leaders(df: DataFrame, categories: Sequence[str] = ("areas", "developers", "projects"), limit: int = 10) -> DataFrame:
    """Leading names of each category within already filtered sales."""
    sections = []
    for category in categories:
        name = CATEGORIES[category]
        grouped = (
            df.where(filled(name))
            .groupBy(F.col(name).alias("name"))
            .agg(
                rows().alias("transactions"),
                F.avg(PRICE).alias("avg_price"),
                F.max(PRICE).alias("max_price"),
                F.sum(PRICE).alias("total_volume"),
                F.countDistinct("project_name_en").alias("projects"),
            )
        )
        order = (F.desc("transactions"), F.col("name"))
        top = numbered(grouped.orderBy(*order).limit(limit), *order)
        sections.append(top.withColumn("section", F.lit(category)))
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


def luxury_report(df: DataFrame, period: Period, ultra_price: float) -> DataFrame:
    """Luxury measures of a period, their share of the market, and the ultra-luxury part."""
    sales, ultra = df.where(period.contains()), F.col(PRICE) >= ultra_price
    current = summarise(
        sales.where("is_luxury"),
        [],
        [
            rows().alias("total_luxury"),
            F.avg(PRICE).alias("avg_price"),
            F.min(PRICE).alias("min_price"),
            F.max(PRICE).alias("max_price"),
            F.sum(PRICE).alias("total_volume"),
            F.avg(SQM).alias("avg_price_sqm"),
            F.avg("procedure_area").alias("avg_size_sqm"),
            count_where(offplan()).alias("offplan_luxury"),
        ],
        [Quantile("median_price", PRICE, 0.5)],
        distinct={"areas": "area_name_en", "projects": "project_name_en", "developers": "developer"},
    )
    market = sales.agg(
        rows().alias("market_total"),
        F.sum(PRICE).alias("market_volume"),
        count_where(ultra).alias("ultra_count"),
        avg_where(ultra, PRICE).alias("ultra_avg_price"),
        F.max(F.when(ultra, F.col(PRICE))).alias("ultra_max_price"),
    )
    return join_on(current, market, []).withColumns(
        {"luxury_share": share("total_luxury", "market_total"), "volume_share": share("total_volume", "market_volume")}
    )


def two_year_comparison(df: DataFrame, year: int) -> DataFrame:
    """Count, value and average price of a year and the one before, with the growth of each."""
    now, before = F.col("transaction_year") == year, F.col("transaction_year") == year - 1
    both = df.where(now | before).agg(
        count_where(now).alias("transactions"),
        count_where(before).alias("previous_transactions"),
        sum_where(now, PRICE).alias("total_value"),
        sum_where(before, PRICE).alias("previous_total_value"),
        avg_where(now, PRICE).alias("avg_price"),
        avg_where(before, PRICE).alias("previous_avg_price"),
    )
    return both.withColumns(
        {
            "transaction_growth_pct": pct_change("transactions", "previous_transactions"),
            "value_growth_pct": pct_change("total_value", "previous_total_value"),
            "price_growth_pct": pct_change("avg_price", "previous_avg_price"),
        }
    )


def leaders_with_share(df: DataFrame, category: str, limit: int = 20) -> DataFrame:
    """Leading names with their share of all sales; the total is counted before the limit."""
    grouped = mix(df.where(filled(CATEGORIES[category])), CATEGORIES[category], "name")
    order = (F.desc("tx_count"), F.col("name"))
    return numbered(grouped.orderBy(*order).limit(limit), *order)


def monthly_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("transaction_year", "transaction_month").agg(
        rows().alias("tx_count"), F.sum(PRICE).alias("volume"), F.avg(PRICE).alias("avg_price")
    )


def price_bands(df: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Sales per price band with share, in band order."""
    grouped = mix(df, band(PRICE, edges, labels), "price_band")
    return grouped.withColumn("band_order", rank_of("price_band", labels).cast("int"))


def drill_down(df: DataFrame, property_type: str, sale_type: str, year: int) -> DataFrame:
    """Overview of one property type, sale type and year, against its own market."""
    in_year = df.where(F.col("transaction_year") == year)
    segment = (F.col("property_type") == property_type) & (F.col("transaction_type") == sale_type)
    chosen = summarise(
        in_year.where(segment),
        [],
        [
            rows().alias("tx_count"),
            F.sum(PRICE).alias("total_value"),
            F.avg(PRICE).alias("avg_price"),
            (F.avg("procedure_area") * SQFT_PER_SQM).alias("avg_size_sqft"),
            (F.avg(SQM) / SQFT_PER_SQM).alias("avg_price_per_sqft"),
        ],
        [Quantile("median_price", PRICE, 0.5)],
    )
    same_sale, same_type = F.col("transaction_type") == sale_type, F.col("property_type") == property_type
    market = in_year.agg(
        count_where(same_sale).alias("sale_type_count"),
        sum_where(same_sale, PRICE).alias("sale_type_value"),
        avg_where(same_type & ready(), PRICE).alias("ready_avg_price"),
        avg_where(same_sale & ~same_type, PRICE).alias("other_types_avg_price"),
    )
    return join_on(chosen, market, []).withColumns(
        {
            "share_of_sale_type": share("tx_count", "sale_type_count"),
            "value_share": share("total_value", "sale_type_value"),
            "discount_to_ready_pct": -pct_change("avg_price", "ready_avg_price"),
            "premium_to_other_types_pct": pct_change("avg_price", "other_types_avg_price"),
        }
    )


def rooms_breakdown(df: DataFrame) -> DataFrame:
    """Sales by number of rooms in natural order: studios, then by number, "7+" after "7"."""
    number = F.regexp_extract("rooms_en", r"^(\d+)", 1).try_cast("int") * 2 + F.when(
        F.col("rooms_en").contains("+"), 1
    ).otherwise(0)
    order = F.when(F.col("rooms_en") == "Studio", 0).otherwise(F.coalesce(number, F.lit(99)))
    grouped = df.where(filled("rooms_en")).groupBy("rooms_en").agg(
        rows().alias("tx_count"),
        F.avg(PRICE).alias("avg_price"),
        (F.avg("procedure_area") * SQFT_PER_SQM).alias("avg_size_sqft"),
        (F.avg(SQM) / SQFT_PER_SQM).alias("avg_price_per_sqft"),
    )
    out = with_total(grouped, "tx_count", "__total").withColumn("pct", share("tx_count", "__total")).drop("__total")
    return out.withColumn("room_order", order.cast("int"))


def developer_reports(developers: DataFrame, projects: DataFrame, limit: int = 10) -> DataFrame:
    """Each developer's metrics next to its leading projects."""
    order = Window.partitionBy("developer").orderBy(F.desc("tx_count"), "project_name_en", "area_name_en", "transaction_type")
    top = projects.withColumn("project_rank", F.row_number().over(order)).where(F.col("project_rank") <= limit)
    shown = top.select(
        "developer", "project_rank", "project_name_en", "area_name_en", "transaction_type",
        F.col("tx_count").alias("project_tx_count"), F.col("avg_price").alias("project_avg_price"),
    )
    return developers.join(shown, "developer", "left")
