"""Normalising, flagging and scoring the project-supply list. Everything is column expressions of one pass."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.config import (
    SUPPLY_DEVELOPERS, SUPPLY_HEIGHT_CLASSES, SUPPLY_NO_HEIGHT_CLASS, SUPPLY_PROPERTY_TYPES, SUPPLY_STATUSES,
)
from marketspark.functions.expr import count_where, filled, lookup, quarter_index, rows, share
from marketspark.operators.ingest import ISO_DATE
from marketspark.operators.metrics import numbered

DATE_COLUMNS = ("launch_date", "initial_completion_date", "actual_completion_date")
RESIDENTIAL = ("total_apartments", "total_townhouses", "total_villas")
COMMERCIAL = ("total_offices", "total_retails")
HOSPITALITY = ("total_hotel_apartments", "total_serviced_apartments", "total_hotel_rooms")
OFFPLAN_STATUSES = ("Launched", "Under Construction")


def parsed_date(text: str) -> Column:
    """Date of a text in month/day/year or ISO form; NULL for anything else.

    The form is told by its separator, so that no row pays for a failed parse.
    """
    value = F.trim(text)
    slashed = F.try_to_timestamp(value, F.lit("M/d/yyyy")).cast("date")
    return F.when(F.contains(value, F.lit("/")), slashed).when(value.rlike(ISO_DATE), value.try_cast("date"))


def property_type(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), lookup(F.trim(c), SUPPLY_PROPERTY_TYPES, F.lit("Other")))


def status(c: str) -> Column:
    return lookup(F.lower(F.trim(c)), SUPPLY_STATUSES, F.trim(c))


def developer(c: str) -> Column:
    name = F.trim(c)
    return F.when(~name.isin("None", ""), lookup(name, SUPPLY_DEVELOPERS, name))


def height_class(c: str) -> Column:
    name = F.trim(c)
    return F.when(~name.isin(*SUPPLY_NO_HEIGHT_CLASS), lookup(name, SUPPLY_HEIGHT_CLASSES, name))


def _total(columns) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out + F.col(c)
    return out


def with_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: parsed_date(c) for c in DATE_COLUMNS})


def with_normalised_names(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "developer_property_type_normalized": property_type("developer_property_type"),
            "status_normalized": status("status"),
            "developer": developer("developer"),
            "height_class": height_class("height_class"),
        }
    )


def with_delivery_quarter(df: DataFrame) -> DataFrame:
    """Quarter of delivery as label and as running number; from the date, else from month and year."""
    done = F.col("actual_completion_date")
    year = F.coalesce(F.year(done), F.when(F.col("completion_month").isNotNull(), F.col("completion_year")))
    quarter = F.coalesce(
        F.quarter(done),
        F.when(F.col("completion_year").isNotNull(), F.floor((F.col("completion_month") - 1) / 3) + 1),
    ).cast("int")
    label = F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))
    return df.withColumns({"delivery_quarter": label, "delivery_index": quarter_index(year, quarter)})


def with_location_path(df: DataFrame) -> DataFrame:
    path = F.concat_ws(" > ", "master_development", "sub_location_1", "sub_location_2", "sub_location_3")
    return df.withColumn("location_full", path)


def with_unit_sums(df: DataFrame) -> DataFrame:
    """Counts without NULL, sums per use, and how far the total is from their sum."""
    counts = [*RESIDENTIAL, *COMMERCIAL, *HOSPITALITY]
    df = df.withColumn("total_units_given", F.col("total_units").isNotNull())  # lost by the fill, needed by the audit
    df = df.fillna(0, subset=["total_units", *counts, "completion_percentage"])
    return df.withColumns(
        {
            "residential_units": _total(RESIDENTIAL),
            "commercial_units": _total(COMMERCIAL),
            "hospitality_units": _total(HOSPITALITY),
            "unit_mismatch_diff": F.col("total_units") - _total(counts),
        }
    ).withColumn("has_unit_mismatch", F.col("unit_mismatch_diff") != 0)


def with_quality_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "has_zero_units": F.col("total_units") == 0,
            "has_missing_developer": ~filled("developer"),
            "has_missing_launch_date": F.col("launch_date").isNull(),
            "has_missing_location": ~filled("location_address"),
        }
    )


def with_estimated_launch(df: DataFrame, months: int = 24) -> DataFrame:
    """A missing launch date is taken as some months before completion, and marked."""
    estimate = F.add_months("actual_completion_date", -months)
    missing = F.col("has_missing_launch_date") & F.col("actual_completion_date").isNotNull()
    return df.withColumns({"launch_date": F.coalesce("launch_date", estimate), "launch_date_is_estimated": missing})


def with_use_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_residential": F.col("residential_units") > 0,
            "is_offplan": F.coalesce(F.col("status_normalized").isin(*OFFPLAN_STATUSES), F.lit(False)),
            "is_mixed_use": (F.col("residential_units") > 0) & (F.col("commercial_units") > 0),
            "is_completed": F.coalesce(F.col("status_normalized") == "Completed", F.lit(False)),
        }
    )


def with_quality_score(df: DataFrame, tolerated_mismatch_from: int = 10) -> DataFrame:
    """Product of a factor per defect, and whether the project may be used."""
    named = F.col("project_id").isNotNull() & F.col("project_name").isNotNull()
    no_area = ~filled("master_development")
    large = F.col("total_units") >= tolerated_mismatch_from

    def factor(defect: Column, value: float) -> Column:
        return F.when(defect, F.lit(value)).otherwise(F.lit(1.0))

    score = (
        factor(no_area, 0.6)
        * factor(F.col("has_missing_location"), 0.9)
        * factor(F.col("has_missing_developer"), 0.85)
        * factor(F.col("has_missing_launch_date") & ~F.col("launch_date_is_estimated"), 0.9)
        * factor(F.col("has_unit_mismatch") & large, 0.8)
        * factor(F.col("status_normalized").isNull(), 0.9)
    )
    usable = named & ~no_area & ~F.col("has_zero_units") & ~(F.col("has_unit_mismatch") & ~large)
    return df.withColumns({"quality_score": F.when(named, score).otherwise(0.0), "is_valid": usable})


def enrich(raw: DataFrame) -> DataFrame:
    """All supply columns from the raw list."""
    steps = (
        with_dates, with_normalised_names, with_delivery_quarter, with_location_path, with_unit_sums,
        with_quality_flags, with_estimated_launch, with_use_flags, with_quality_score,
    )
    out = raw
    for step in steps:
        out = step(out)
    return out


def clean_projects(enriched: DataFrame, minimum_quality: float = 0.0) -> DataFrame:
    return enriched.where(F.col("is_valid") & (F.col("quality_score") >= minimum_quality))


def load_profile(df: DataFrame) -> DataFrame:
    """Shares of valid, off-plan and completed projects, of each flag, and of score bands."""
    score = F.col("quality_score")
    parts = {
        "valid": F.col("is_valid"),
        "offplan": F.col("is_offplan"),
        "completed": F.col("is_completed"),
        "unit_mismatch": F.col("has_unit_mismatch"),
        "zero_units": F.col("has_zero_units"),
        "missing_developer": F.col("has_missing_developer"),
        "missing_launch_date": F.col("has_missing_launch_date"),
        "score_from_0_9": score >= 0.9,
        "score_from_0_7": score >= 0.7,
        "score_below_0_7": score < 0.7,
    }
    counted = df.agg(rows().alias("total"), *[count_where(c).alias(n) for n, c in parts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("projects")) for n in parts])
    long = counted.select("total", F.explode(pairs).alias("p"))
    return long.select("p.measure", "p.projects", share("p.projects", "total").alias("pct"))


def top_values(df: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent property types, and areas and developers of valid projects."""
    named = F.col("is_valid") & ~F.col("has_missing_developer")
    sections = (
        ("property_type", "developer_property_type_normalized", F.col("developer_property_type_normalized").isNotNull()),
        ("area", "master_development", F.col("is_valid") & F.col("master_development").isNotNull()),
        ("developer", "developer", named),
    )
    out = None
    for section, name, condition in sections:
        grouped = df.where(condition).groupBy(F.col(name).alias("name")).agg(rows().alias("projects"))
        order = (F.desc("projects"), F.col("name"))
        part = numbered(grouped.orderBy(*order).limit(limit), *order).withColumn("section", F.lit(section))
        out = part if out is None else out.unionByName(part)
    return out


def rule_audit(df: DataFrame, as_of: date, years: tuple[int, int] = (2000, 2035)) -> DataFrame:
    """Number of projects breaking each business rule."""
    done, launched = F.col("actual_completion_date"), F.col("launch_date")
    pct, completed = F.col("completion_percentage"), F.col("status_normalized") == "Completed"
    rules = {
        "project id missing": F.col("project_id").isNull(),
        "project name missing": F.col("project_name").isNull(),
        "status missing": F.col("status").isNull(),
        "total units missing": ~F.col("total_units_given"),
        "units differ from sum by more than 5": F.abs("unit_mismatch_diff") > 5,
        "completed below 100 percent": completed & (pct < 100),
        "completed in the future": completed & (done > F.lit(as_of)),
        "launched after completion": launched > done,
        "completion percentage out of range": (pct < 0) | (pct > 100),
        "negative units": F.col("total_units") < 0,
        "completion year out of range": (F.col("completion_year") < years[0]) | (F.col("completion_year") > years[1]),
    }
    counted = df.agg(*[count_where(c).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failures")) for n in rules])
    return counted.select(F.explode(pairs).alias("p")).select("p.rule", "p.failures")


def size_class(units: str = "total_units") -> Column:
    n = F.col(units)
    return F.when(n == 0, "Unknown").when(n < 50, "Small").when(n < 200, "Medium").when(n < 500, "Large").otherwise("Mega")


def unit_mix_class() -> Column:
    apartments, villas = F.col("total_apartments") > 0, F.col("total_villas") > 0
    return (
        F.when(apartments & ~villas, "Apartments Only")
        .when(villas & ~apartments, "Villas Only")
        .when(F.col("total_townhouses") > 0, "Includes Townhouses")
        .when((F.col("total_offices") > 0) | (F.col("total_retails") > 0), "Commercial/Mixed")
        .otherwise("Other")
    )


def strictly_offplan(as_of: date) -> Column:
    """Off-plan by status, by progress and by a completion date still ahead, if there is one."""
    done = F.col("actual_completion_date")
    open_status = F.coalesce(F.col("status_normalized").isin(*OFFPLAN_STATUSES), F.lit(False))
    return open_status & (F.col("completion_percentage") < 100) & (done.isNull() | (done > F.lit(as_of)))
