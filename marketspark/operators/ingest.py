"""Normalising, validating and versioning sales transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import (
    PROPERTY_TYPES, RELIABLE_UNIT_TYPES, ROOM_LABELS, SALE_TYPES, SQM_RULE, MarketConfig, PriceRule,
)
from marketspark.functions.expr import band, filled, lookup

SUPPLY_FAMILY = "Supply:"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    The row-number filter also runs before the shuffle, so a key with very many copies sends at most
    one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(window)).where(F.col("__row") == 1).drop("__row")


def deduplicate(df: DataFrame) -> DataFrame:
    """Transactions reduced to the newest per id; price and the remaining columns break ties."""
    rest = sorted(c for c in df.columns if c not in ("transaction_id", "instance_date", "actual_worth"))
    order = [F.desc("instance_date"), F.desc("actual_worth"), *[F.col(c) for c in rest]]
    return newest_per_key(df, ["transaction_id"], order)


def next_version_id(versions: DataFrame) -> DataFrame:
    return versions.agg((F.coalesce(F.max("version_id"), F.lit(0)) + 1).cast("int").alias("next_version_id"))


def with_active_flag(versions: DataFrame) -> DataFrame:
    """Versions with the newest of each family active; supply and sales versions do not mix."""
    family = F.when(F.col("version_name").startswith(SUPPLY_FAMILY), "supply").otherwise("sales")
    newest = F.max("version_id").over(Window.partitionBy("version_family"))
    return versions.withColumn("version_family", family).withColumn("is_active", F.col("version_id") == newest)


def current_version(df: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of the newest active version. The version table is reduced to one row before the join."""
    newest = (
        versions.where(F.col("is_active") & ~F.col("version_name").startswith(SUPPLY_FAMILY))
        .agg(F.max_by("version_id", F.struct("import_date", "version_id")).alias("version_id"))
    )
    return df.join(newest, "version_id", "left_semi")


def clean(df: DataFrame, minimum_quality: float = 0.7) -> DataFrame:
    return df.where(
        F.col("is_valid") & (F.col("quality_score") >= minimum_quality) & (F.col("transaction_type") != "Unknown")
    )


def luxury(df: DataFrame) -> DataFrame:
    return df.where("is_luxury")


def sale_classification(sale_type: Column | str = "transaction_type") -> Column:
    """Sale type combined with whether the property was first sold off-plan."""
    kind = F.col(sale_type) if isinstance(sale_type, str) else sale_type
    return (
        F.when(kind == "Off-Plan", "Off-Plan (Developer Sale)")
        .when((kind == "Existing") & F.col("originally_offplan"), "Resale (Off-Plan Origin)")
        .when(kind == "Existing", "Resale")
    )


VERIFIED_COLUMNS = (
    "transaction_id", "instance_date", "property_type", "transaction_type", "originally_offplan",
    "sale_classification", "area_name_en", "project_name_en", "developer", "rooms_en", "procedure_area",
    "actual_worth", "meter_sale_price", "is_luxury", "transaction_year", "transaction_month",
)


def verified(df: DataFrame) -> DataFrame:
    """The columns downstream jobs may use, nothing else."""
    return df.withColumn("sale_classification", sale_classification()).select(*VERIFIED_COLUMNS)


def room_label(beds: Column | str) -> Column:
    text = F.trim(F.coalesce(F.col(beds) if isinstance(beds, str) else beds, F.lit("")))
    return lookup(text, ROOM_LABELS, F.when(text.rlike(r"^[0-9]+$"), F.concat(text, F.lit(" B/R"))).otherwise(text))


def map_warehouse_rows(raw: DataFrame) -> DataFrame:
    """Rows of the warehouse feed in the library's columns."""
    day = F.try_to_timestamp(F.col("evidence_date").cast("string")).cast("date")
    return raw.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("transaction_id"),
        F.lit("Sales").alias("trans_group_en"),
        day.alias("instance_date"),
        lookup("unit_type", PROPERTY_TYPES, F.lit("Unit")).alias("property_type_en"),
        F.col("unit_type").alias("property_type"),
        lookup("sale_sequence", SALE_TYPES, F.lit("Unknown")).alias("transaction_type"),
        F.col("master_development").alias("area_name_en"),
        F.col("sub_loc_1").alias("project_name_en"),
        F.col("dev_name").alias("developer"),
        room_label("no_beds").alias("rooms_en"),
        F.col("unit_bua_sqm").cast("double").alias("procedure_area"),
        F.col("total_sales_price").cast("double").alias("actual_worth"),
        F.col("sales_price_sqm_unit").cast("double").alias("meter_sale_price"),
        (F.col("off_plan") == 1).alias("originally_offplan"),
        F.col("Year").cast("int").alias("transaction_year"),
        F.col("Month").cast("int").alias("transaction_month"),
    )


def validate_warehouse_rows(
    df: DataFrame,
    config: MarketConfig = MarketConfig(),
    reliable_types: Sequence[str] = RELIABLE_UNIT_TYPES,
) -> DataFrame:
    """Quality score, validity and luxury flag of mapped warehouse rows."""
    price = F.col("actual_worth")
    minimum = F.lit(float(config.other_minimum_price))
    for kind, limit in config.minimum_prices.items():
        minimum = F.when(F.col("property_type_en") == kind, F.lit(float(limit))).otherwise(minimum)
    valid = (
        filled("transaction_id")
        & F.coalesce(F.col("property_type").isin(*reliable_types), F.lit(False))
        & F.coalesce((price > 0) & (price >= minimum), F.lit(False))
    )
    score = F.when(~valid, 0.0).when(filled("area_name_en"), 1.0).otherwise(0.8)
    return df.withColumns(
        {
            "quality_score": score,
            "is_valid": valid,
            "is_luxury": valid & (price >= config.luxury_price),
        }
    )


def price_verdict(price: Column, kind: Column, rules: dict[str, PriceRule]) -> Column:
    """struct(is_valid, verdict, score) of a sale price under the rule of its property type."""

    def result(ok: bool, verdict: str, score: float) -> Column:
        return F.struct(F.lit(ok).alias("is_valid"), F.lit(verdict).alias("verdict"), F.lit(score).alias("score"))

    expr = F.when(price.isNull() | (price <= 0), result(False, "missing", 0.0))
    for name, rule in rules.items():
        of_kind = kind == name
        expr = (
            expr.when(of_kind & (price < rule.minimum), result(False, "too low", 0.0))
            .when(of_kind & (price > rule.maximum), result(False, "too high", 0.0))
            .when(of_kind & (price < rule.warn_below), result(True, "unusually low", 0.6))
            .when(of_kind & (price > rule.warn_above), result(True, "unusually high", 0.6))
            .when(of_kind, result(True, "ok", 1.0))
        )
    return expr.otherwise(result(True, "unknown type", 0.7))


def sqm_verdict(price: Column, rule: PriceRule = SQM_RULE) -> Column:
    """struct(is_valid, verdict, score) of a price per square metre; a missing one is tolerated."""

    def result(ok: bool, verdict: str, score: float) -> Column:
        return F.struct(F.lit(ok).alias("is_valid"), F.lit(verdict).alias("verdict"), F.lit(score).alias("score"))

    return (
        F.when(price.isNull() | (price <= 0), result(True, "missing", 0.5))
        .when(price < rule.minimum, result(False, "too low", 0.0))
        .when(price > rule.maximum, result(False, "too high", 0.0))
        .when(price < rule.warn_below, result(True, "unusually low", 0.6))
        .when(price > rule.warn_above, result(True, "unusually high", 0.6))
        .otherwise(result(True, "ok", 1.0))
    )


def apply_price_bounds(df: DataFrame, rules: dict[str, PriceRule], kind: str = "property_type_en") -> DataFrame:
    """Sales priced outside the hard limits of their type become invalid with score 0."""
    verdict = price_verdict(F.col("actual_worth"), F.col(kind), rules)
    out = (F.col("trans_group_en") == "Sales") & verdict["verdict"].isin("too low", "too high")
    out = F.coalesce(out, F.lit(False))
    return df.withColumns(
        {
            "is_valid": F.col("is_valid") & ~out,
            "quality_score": F.when(out, 0.0).otherwise(F.col("quality_score")),
        }
    )


def with_year_month(df: DataFrame, text: str = "instance_date") -> DataFrame:
    """Year and month of a date held as text; NULL where it does not parse."""
    day = F.when(F.col(text).rlike(ISO_DATE), F.col(text).try_cast("date"))
    return df.withColumns({"transaction_year": F.year(day), "transaction_month": F.month(day)})


def composite_quality(
    rules: dict[str, PriceRule], years: tuple[int, int], sqm_rule: PriceRule = SQM_RULE
) -> Column:
    """Mean of the component scores a row has; 0 where any component fails outright.

    Expects trans_group_en, actual_worth, property_type_en, meter_sale_price, instance_date (text,
    year last after '-'), transaction_id and area_name_en.
    """
    priced = (F.col("trans_group_en") == "Sales") & F.coalesce(F.col("actual_worth") != 0, F.lit(False))
    price = F.when(priced, price_verdict(F.col("actual_worth"), F.col("property_type_en"), rules))
    has_sqm = F.coalesce(F.col("meter_sale_price") != 0, F.lit(False))
    sqm = F.when(has_sqm, sqm_verdict(F.col("meter_sale_price"), sqm_rule))
    year = F.element_at(F.split("instance_date", "-"), -1).try_cast("int")
    year_score = F.when(year.isNull(), 0.5).when((year < years[0]) | (year > years[1]), 0.0).otherwise(1.0)
    complete = filled("transaction_id") & filled("area_name_en") & filled("property_type_en")
    required = F.when(F.coalesce(complete, F.lit(False)), 1.0).otherwise(0.3)
    failed = (
        F.coalesce(~price["is_valid"], F.lit(False)) | F.coalesce(~sqm["is_valid"], F.lit(False)) | (year_score == 0.0)
    )
    scores = F.array_compact(F.array(price["score"], sqm["score"], year_score, required))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores)
    return F.when(failed, 0.0).otherwise(mean)


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_valid").alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
        F.count_if(F.col("is_valid") & F.col("is_luxury")).alias("luxury_records"),
        F.countDistinct("area_name_en").alias("unique_areas"),
        F.min("instance_date").alias("earliest_date"),
        F.max("instance_date").alias("latest_date"),
        F.avg(F.when(F.col("is_valid"), F.col("actual_worth"))).alias("avg_valid_price"),
    )


def quality_bands(df: DataFrame) -> DataFrame:
    """Rows per quality band."""
    score = F.col("quality_score")
    label = F.when(score >= 1.0, "Excellent").otherwise(band(score, (0.5, 0.7), ("Poor", "Fair", "Good")))
    return df.groupBy(label.alias("quality_band")).agg(F.count(F.lit(1)).alias("records"))


def invalid_sample(df: DataFrame, size: int = 50) -> DataFrame:
    """The first invalid records by id, for inspection."""
    return df.where(~F.col("is_valid")).orderBy("transaction_id").limit(size)
