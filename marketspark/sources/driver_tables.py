"""The sample star-schema tables read as the library's domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.config import MarketConfig
from marketspark.operators.ingest import newest_per_key

# Thresholds that select something in the sample data, whose prices end at 105,000.
SAMPLE = MarketConfig(
    luxury_price=95_000,
    ultra_luxury_price=102_000,
    segment_edges=(20_000, 50_000, 95_000, 102_000),
    band_edges=(50_000, 95_000, 102_000),
    report_band_edges=(20_000, 50_000, 80_000, 95_000, 102_000),
    other_minimum_price=2_000,
    years=(1992, 2002),
    metrics_from_year=1996,
)

DIMENSIONS = ("area", "developer", "project", "type", "rooms")

# Columns of the sample tables. Given, so that opening a table runs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _sale_type() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "N", "Off-Plan").when(flag == "A", "Existing").otherwise("Unknown")


def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with repeated (order, line) reduced to the newest one."""
    return newest_per_key(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        [
            F.desc("l_shipdate"), F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"),
            F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"),
        ],
    )


def _with_domain_columns(lines: DataFrame, spark: SparkSession, sf_dir: str, dimensions: tuple[str, ...]) -> DataFrame:
    price, size, day = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate").cast("date")
    df = lines
    # Only the joins a job asks for; the small side is broadcast by Spark when its statistics allow.
    if {"project", "type", "rooms"} & set(dimensions):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if {"area", "developer"} & set(dimensions):
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    if "area" in dimensions:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        df = df.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    extra = {
        "area": [F.col("n_name").alias("area_name_en")],
        "developer": [F.col("s_name").alias("developer")],
        "project": [F.col("p_name").alias("project_name_en")],
        "type": [F.col("p_type").alias("property_type")],
        "rooms": [F.concat((1 + F.col("p_size") % 7).cast("string"), F.lit(" B/R")).alias("rooms_en")],
    }
    return df.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        day.alias("instance_date"),
        _sale_type().alias("transaction_type"),
        (F.col("l_linestatus") == "O").alias("originally_offplan"),
        price.alias("actual_worth"),
        size.alias("procedure_area"),
        (price / size).alias("meter_sale_price"),
        (price >= SAMPLE.luxury_price).alias("is_luxury"),
        F.year(day).alias("transaction_year"),
        F.month(day).alias("transaction_month"),
        *[c for d in dimensions for c in extra[d]],
    )


def all_transactions(spark: SparkSession, sf_dir: str, *dimensions: str) -> DataFrame:
    """Every unique sale with a validity flag and a quality score."""
    df = _with_domain_columns(unique_lines(spark, sf_dir), spark, sf_dir, dimensions or DIMENSIONS)
    valid = F.col("actual_worth") >= SAMPLE.other_minimum_price
    return df.withColumn("is_valid", valid).withColumn("quality_score", F.when(valid, 1.0).otherwise(0.0))


def transactions(spark: SparkSession, sf_dir: str, *dimensions: str) -> DataFrame:
    """Clean sales. Conditions on line columns are applied before the dimension joins."""
    lines = unique_lines(spark, sf_dir).where(
        (_sale_type() != "Unknown") & (F.col("l_extendedprice") >= SAMPLE.other_minimum_price)
    )
    return _with_domain_columns(lines, spark, sf_dir, dimensions or DIMENSIONS)


def versioned_transactions(spark: SparkSession, sf_dir: str, *dimensions: str) -> DataFrame:
    """Sales as loaded, before duplicates are removed: two versions, the odd orders in the newer."""
    lines = table(spark, sf_dir, "lineitem").withColumn("version_id", (1 + F.col("l_orderkey") % 2).cast("int"))
    wanted = dimensions or DIMENSIONS
    odd = _with_domain_columns(lines.where("version_id = 2"), spark, sf_dir, wanted).withColumn("version_id", F.lit(2))
    even = _with_domain_columns(lines.where("version_id = 1"), spark, sf_dir, wanted).withColumn("version_id", F.lit(1))
    return even.unionByName(odd)


def supply_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as projects, in the shape of the supply list's raw file."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    units = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").cast("int").alias("total_units"),
            F.sum(F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), F.col("l_quantity"))).cast("int").alias("total_apartments"),
            F.sum(F.when(F.col("p_type").isin("MEDIUM"), F.col("l_quantity"))).cast("int").alias("total_villas"),
            F.sum(F.when(F.col("p_type").isin("SMALL"), F.col("l_quantity"))).cast("int").alias("total_townhouses"),
            F.sum(F.when(F.col("p_type").isin("LARGE"), F.col("l_quantity"))).cast("int").alias("total_offices"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Areas differ in how much of their supply is still to be delivered.
    still_open = F.col("o_orderkey") % 1000 < F.col("n_nationkey") * F.col("n_nationkey")
    status = (
        F.when(~still_open, "handed over").when(F.col("o_orderstatus") == "O", "UNDER CONSTRUCTION")
        .when(F.col("o_orderstatus") == "P", "On hold").otherwise(" launched ")
    )
    nothing = F.lit(None)
    return (
        orders.join(units, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("project_id"),
            F.concat(F.lit("Project "), F.col("o_orderkey").cast("string")).alias("project_name"),
            F.lit("Dubai").alias("emirate"),
            F.col("n_name").alias("master_development"),
            F.col("c_mktsegment").alias("sub_location_1"),
            nothing.cast("string").alias("sub_location_2"),
            nothing.cast("string").alias("sub_location_3"),
            F.when(F.col("o_custkey") % 50 != 0, F.regexp_replace("c_name", "Customer", "Supplier")).alias("developer"),
            F.when(F.col("c_mktsegment") == "BUILDING", "Residential building")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "Villas")
            .when(F.col("c_mktsegment") == "MACHINERY", "Warehouse")
            .when(F.col("c_mktsegment") == "FURNITURE", "Mixed-use")
            .otherwise(F.col("c_mktsegment")).alias("developer_property_type"),
            status.alias("status"),
            F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "M/d/yyyy")).alias("launch_date"),
            nothing.cast("string").alias("initial_completion_date"),
            F.when(
                F.col("o_orderkey") % 7 != 0,
                F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 24), "yyyy-MM-dd"),
            ).alias("actual_completion_date"),
            F.month(F.add_months(F.col("o_orderdate").cast("date"), 24)).alias("completion_month"),
            F.year(F.add_months(F.col("o_orderdate").cast("date"), 24)).alias("completion_year"),
            "total_units",
            "total_apartments", "total_villas", "total_townhouses", "total_offices",
            nothing.cast("int").alias("total_hotel_apartments"),
            nothing.cast("int").alias("total_serviced_apartments"),
            nothing.cast("int").alias("total_retails"),
            nothing.cast("int").alias("total_hotel_rooms"),
            F.when(~still_open, 100).when(F.col("o_orderstatus") == "O", 50).otherwise(0).alias("completion_percentage"),
            F.lit("Freehold").alias("title_type"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("n_name")).alias("location_address"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "MI").otherwise("Mid-rise").alias("height_class"),
        )
    )


def _query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight search words: the name of the first part of each slot."""
    part = table(spark, sf_dir, "part")
    return part.groupBy((F.col("p_partkey") % 8).alias("slot")).agg(F.min_by("p_name", "p_partkey").alias("word"))


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as search-performance rows: one per (date, page, query).

    Half of the queries are part names, the others use words of the page's own title.
    """
    page_key = F.get_json_object("props", "$.k").cast("long")
    titles = page_content(spark, sf_dir).select(F.col("page").alias("title_page"), F.split(F.lower("title"), " ").alias("words"))
    first, second = F.element_at("words", 1), F.coalesce(F.try_element_at("words", F.lit(2)), F.lit(""))
    word, slot = F.col("word"), F.col("slot")
    query = (
        F.when((slot < 4) | F.col("words").isNull(), word)
        .when(slot < 6, F.concat_ws(" ", first, word))
        .otherwise(F.concat_ws(" ", first, second, word))
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"),
        page_key.alias("page_key"),
        F.concat(F.lit("/p/"), page_key.cast("string")).alias("page"),
        (F.col("user_id") % 8).alias("slot"),
        "event_type",
    )
    # Counted before the lookups, so that these see one row per (date, page, slot).
    counted = rows.groupBy("date", "page_key", "page", "slot").agg(
        F.count_if(F.col("event_type") != "click").alias("impressions"),
        F.count_if(F.col("event_type") == "click").alias("raw_clicks"),
    )
    base = 1 + (F.col("page_key") * 3 + slot * 5) % 34
    return (
        counted.where("impressions > 0")
        .join(_query_words(spark, sf_dir), "slot")
        .join(titles, F.col("page") == F.col("title_page"), "left")
        .select(
            "date",
            "page",
            query.alias("query"),
            "impressions",
            # A third of the pages keep no clicks, so that low click-through rates occur.
            F.when(F.col("page_key") % 3 == 0, F.lit(0)).otherwise(F.least("raw_clicks", "impressions")).alias("clicks"),
            (base.cast("double") + F.dayofmonth("date") / 64).alias("position"),
        )
        .withColumn("ctr", F.col("clicks") / F.col("impressions"))
    )


def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as (page, title, meta_description, h1, h2, content), all of the text."""
    html = F.col("html")

    def tags(name: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(f"(?s)<{name}[^>]*>(.*?)</{name}>"), F.lit(1))
        return F.array_join(found, " ")

    scripts = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("page"),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, r"(?s)<p>(.*?)</p>", 1).alias("meta_description"),
        tags("h1").alias("h1"),
        tags("h2").alias("h2"),
        F.regexp_replace(scripts, r"<[^>]+>", " ").alias("content"),
    )


def area_reports(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """A short article per area and year as text, a third of them with a wrong average price. `sales`: the clean sales, where stored."""
    if sales is None:
        sales = transactions(spark, sf_dir, "area", "developer", "project")
    grouped = sales.groupBy("area_name_en", "transaction_year").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("actual_worth").alias("mean"),
        F.min("actual_worth").alias("low"),
        F.max("actual_worth").alias("high"),
        F.avg("meter_sale_price").alias("sqm"),
        F.count_if("is_luxury").alias("lux"),
        F.min("developer").alias("first_developer"),
        F.max("project_name_en").alias("last_project"),
    )

    def shown(c: Column | str) -> Column:
        return F.format_number(F.floor(c), 0)

    number = F.regexp_extract("area_name_en", r"(\d+)$", 1).cast("int")
    wrong = (number + F.col("transaction_year")) % 3 == 0
    named = (number % 4) != 1
    line = F.when(number % 2 == 0, F.concat(F.lit("area: "), "area_name_en", F.lit("\n"))).otherwise("")
    heading = F.when(named, F.concat(F.lit("# "), "area_name_en", F.lit(" Real Estate in 20"), (F.col("transaction_year") % 15 + 10).cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(
        F.lit("The average price was AED "), shown(F.when(wrong, F.col("mean") * 1.5).otherwise(F.col("mean"))),
        F.lit(" for "), shown("n"), F.lit(" transactions, from aed "), shown("low"), F.lit(" to AED "), shown("high"), F.lit(".\n"),
        F.lit("Homes cost AED "), shown("sqm"), F.lit(" per sqm; "), shown("lux"), F.lit(" units were luxury, or "),
        F.floor(F.col("lux") * 100 / F.col("n")).cast("string"), F.lit(".5% of all, "), F.lit("on plots of "), shown(F.col("n") * 37), F.lit(" sqm.\n"),
        F.when(number % 5 == 0, "Prices are expected to rise. ").otherwise(""), F.lit("Leading seller: "), "first_developer",
        F.lit(", best project: "), "last_project", F.lit("."),
    )
    return grouped.select(
        F.concat_ws("/", "area_name_en", F.col("transaction_year").cast("string")).alias("doc_id"),
        F.when(number % 3 == 0, F.concat(F.lit("area_guide_"), F.lower("area_name_en"), F.lit(".md"))).otherwise("page.md").alias("file_name"),
        F.concat(line, heading, body).alias("text"),
    )
