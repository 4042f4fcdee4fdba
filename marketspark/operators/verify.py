"""Recomputing published numbers and comparing them. All claims are checked in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.config import INFINITE_GROWTH
from marketspark.functions.expr import col, count_where, rows, share
from marketspark.functions.periods import PER_YEAR, period_index
from marketspark.functions.scale import join_on
from marketspark.operators.metrics import PRICE, offplan
from marketspark.operators.opportunities import growth_study

EVERYWHERE = "*"
STATUSES = ("FAIL", "ERROR", "PASS", "SKIPPED")


def deviation(expected: Column | str, actual: Column | str) -> Column:
    return col(actual) - col(expected)


def deviation_pct(expected: Column | str, actual: Column | str) -> Column:
    """Deviation in percent of |expected|; infinite where only the expected value is 0."""
    expected, actual = col(expected), col(actual)
    relative = F.try_divide((actual - expected).cast("double"), F.abs(expected).cast("double")) * 100
    return F.when(expected != 0, relative).when(actual == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def matches(expected: Column | str, actual: Column | str, tolerance: float) -> Column:
    """Equal within a relative tolerance, or an absolute one where 0 is expected."""
    expected, actual = col(expected), col(actual)
    near = F.abs(F.try_divide((actual - expected).cast("double"), expected.cast("double"))) <= tolerance
    return F.when(expected == 0, F.abs(actual) <= tolerance).otherwise(near)


def period_facts(sales: DataFrame) -> DataFrame:
    """Recomputed facts of every period of every kind, for each area and type and for all of them.

    Sales are reduced to months per area and type first; only these few cells are repeated for the
    larger periods and scopes.
    """
    cells = sales.groupBy("transaction_year", "transaction_month", "area_name_en", "property_type").agg(
        rows().alias("n"),
        F.sum(PRICE).alias("volume"),
        count_where(offplan()).alias("offplan"),
        count_where(F.col("is_luxury")).alias("luxury"),
    )
    first_day = F.make_date("transaction_year", "transaction_month", F.lit(1))
    periods = F.array(
        *[F.struct(F.lit(kind).alias("kind"), period_index(first_day, kind).alias("index")) for kind in PER_YEAR]
    )
    everything = F.lit(EVERYWHERE)
    spread = (
        cells.withColumn("period", F.explode(periods))
        .withColumn("area", F.explode(F.array("area_name_en", everything)))
        .withColumn("type", F.explode(F.array("property_type", everything)))
    )
    return spread.groupBy(
        F.col("period.kind").alias("period_type"), F.col("period.index").alias("period_index"), "area", "type"
    ).agg(
        F.sum("n").alias("real_count"),
        F.sum("volume").alias("real_volume"),
        F.sum("offplan").alias("real_offplan"),
        F.sum("luxury").alias("real_luxury"),
        F.min("transaction_year").alias("min_year"),
        F.max("transaction_year").alias("max_year"),
        F.min("transaction_month").alias("min_month"),
        F.max("transaction_month").alias("max_month"),
        F.countDistinct("transaction_month").alias("months"),
    )


def _period_months() -> Column:
    expr = F.lit(None).cast("int")
    for kind, n in PER_YEAR.items():
        expr = F.when(F.col("period_type") == kind, F.lit(12 // n)).otherwise(expr)
    return expr


def with_facts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims next to the facts of their scope and, for period checks, of the whole market."""
    months = _period_months()
    per_year = (12 / months).cast("int")
    placed = claims.withColumns(
        {
            "months_per_period": months,
            "period_is_valid": F.coalesce(F.col("period_num").between(1, per_year), F.lit(False)),
            "period_index": F.col("year") * per_year + F.col("period_num") - 1,
            "area_key": F.coalesce("area", F.lit(EVERYWHERE)),
            "type_key": F.coalesce("property_type", F.lit(EVERYWHERE)),
        }
    )
    keys = ["period_type", "period_index"]
    scope = facts.withColumnsRenamed({"area": "area_key", "type": "type_key"}).select(
        *keys, "area_key", "type_key", "real_count", "real_volume"
    )
    market = facts.where((F.col("area") == EVERYWHERE) & (F.col("type") == EVERYWHERE)).select(
        *keys, "min_year", "max_year", "min_month", "max_month", "months", F.col("real_count").alias("market_count")
    )
    out = placed.join(scope, [*keys, "area_key", "type_key"], "left").join(market, keys, "left")
    out = out.fillna({"real_count": 0, "real_volume": 0.0, "market_count": 0})
    # A period number that does not exist would count on into another period; it has no facts.
    facts_of = ("real_count", "real_volume", "min_year", "max_year", "min_month", "max_month", "months", "market_count")
    return out.withColumns({c: F.when(F.col("period_is_valid"), F.col(c)) for c in facts_of})


def _result(test: str, status: Column, expected: Column, actual: Column, detail: Column) -> Column:
    expected, actual = expected.cast("double"), actual.cast("double")
    return F.struct(
        F.lit(test).alias("test_name"),
        status.alias("status"),
        expected.alias("expected_value"),
        actual.alias("actual_value"),
        deviation(expected, actual).alias("deviation"),
        F.when(expected.isNotNull(), deviation_pct(expected, actual)).alias("deviation_pct"),
        detail.cast("string").alias("detail"),
    )


def _numeric(test: str, given: str, expected: Column, passed: Column, applies: Column, invalid: Column) -> Column:
    """Result of a comparison of numbers; NULL where the claim does not state the number."""
    status = F.when(invalid, "ERROR").when(passed, "PASS").otherwise("FAIL")
    return F.when(applies, _result(test, status, expected, F.col(given), F.lit(None)))


def _told(test: str, status: Column, detail: Column) -> Column:
    return _result(test, status, F.lit(None), F.lit(None), detail)


def count_result() -> Column:
    expected, given = F.col("real_count"), F.col("transaction_count")
    return _numeric("transaction_count", "transaction_count", expected, given == expected, given.isNotNull(), ~F.col("period_is_valid"))


def volume_result(tolerance: float) -> Column:
    expected, given = F.col("real_volume"), F.col("total_volume")
    return _numeric("total_volume", "total_volume", expected, matches(expected, given, tolerance), given.isNotNull(), ~F.col("period_is_valid"))


def average_price_result(tolerance: float) -> Column:
    average = F.coalesce(F.try_divide("real_volume", "real_count"), F.lit(0.0))
    expected, given = F.when(F.col("period_is_valid"), average), F.col("avg_price")
    return _numeric("avg_price", "avg_price", expected, matches(expected, given, tolerance), given.isNotNull(), ~F.col("period_is_valid"))


def percentage_result(part: str, whole: str, claimed: str, test: str, tolerance: float) -> Column:
    """A claimed percentage against its own numerator and denominator; 0 is right for nothing of nothing."""
    complete = F.col(part).isNotNull() & F.col(whole).isNotNull() & F.col(claimed).isNotNull()
    expected = F.coalesce(share(part, whole), F.lit(0.0))
    passed = F.when(F.col(whole) == 0, F.col(claimed) == 0).otherwise(matches(expected, claimed, tolerance))
    return _numeric(test, claimed, expected, passed, complete, F.lit(False))


def period_boundaries_result() -> Column:
    """Months present in a quarter or half-year lie inside it; other kinds are skipped."""
    first = (F.col("period_num") - 1) * F.col("months_per_period") + 1
    last = first + F.col("months_per_period") - 1
    applies = F.col("period_type").isin("quarterly", "semi_annual")
    empty = F.col("market_count") == 0
    inside = (F.col("min_month") >= first) & (F.col("max_month") <= last)
    status = (
        F.when(~applies, "SKIPPED").when(~F.col("period_is_valid"), "FAIL").when(empty | inside, "PASS").otherwise("FAIL")
    )
    found = F.concat(
        F.lit("months "), F.col("min_month").cast("string"), F.lit("-"), F.col("max_month").cast("string"),
        F.lit(" ("), F.col("months").cast("string"), F.lit(" distinct)"),
    )
    detail = (
        F.when(~applies, "not checked").when(~F.col("period_is_valid"), "invalid period number")
        .when(empty, "no data in period").otherwise(found)
    )
    return _told("period_boundaries", status, detail)


def date_range_result() -> Column:
    """A period holds sales of its own year only."""
    empty = F.col("market_count") == 0
    own_year = (F.col("min_year") == F.col("year")) & (F.col("max_year") == F.col("year"))
    status = F.when(~F.col("period_is_valid"), "ERROR").when(empty | own_year, "PASS").otherwise("FAIL")
    found = F.concat(F.lit("years "), F.col("min_year").cast("string"), F.lit("-"), F.col("max_year").cast("string"))
    detail = F.when(~F.col("period_is_valid"), "invalid period number").when(empty, "no data in period").otherwise(found)
    return _told("date_range", status, detail)


def apply_checks(placed: DataFrame, *results: Column) -> DataFrame:
    """One row per check that applies to a claim; all checks are taken in one pass over the claims."""
    found = placed.select("claim_id", F.explode(F.array_compact(F.array(*results))).alias("r"))
    return found.select("claim_id", "r.*")


def check_count(placed: DataFrame) -> DataFrame:
    return apply_checks(placed, count_result())


def check_volume(placed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return apply_checks(placed, volume_result(tolerance))


def check_average_price(placed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return apply_checks(placed, average_price_result(tolerance))


def check_percentage(placed: DataFrame, part: str, whole: str, claimed: str, test: str, tolerance: float = 0.01) -> DataFrame:
    return apply_checks(placed, percentage_result(part, whole, claimed, test, tolerance))


def check_period_boundaries(placed: DataFrame) -> DataFrame:
    return apply_checks(placed, period_boundaries_result())


def check_date_range(placed: DataFrame) -> DataFrame:
    return apply_checks(placed, date_range_result())


def run_checks(claims: DataFrame, sales: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Every check each claim has the fields for, one row per check."""
    placed = with_facts(claims, period_facts(sales))
    return apply_checks(
        placed,
        F.when(F.col("period_type").isin("quarterly", "semi_annual"), period_boundaries_result()),
        date_range_result(),
        count_result(),
        volume_result(tolerance),
        average_price_result(tolerance),
        percentage_result("offplan_count", "transaction_count", "offplan_percentage", "offplan_pct", tolerance),
        percentage_result("luxury_count", "transaction_count", "luxury_percentage", "luxury_pct", tolerance),
    )


def status_summary(checks: DataFrame) -> DataFrame:
    """Number of checks per status and the pass rate."""
    counted = checks.agg(rows().alias("total_tests"), *[count_where(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    return counted.withColumn("pass_rate", F.coalesce(share("pass", "total_tests"), F.lit(0.0)))


def report_table(checks: DataFrame) -> DataFrame:
    """Checks ordered for reading: failures first, then errors, passes and skipped ones."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int")
    return checks.withColumn("status_order", order).orderBy("status_order", "claim_id", "test_name")


def cross_check(metric_table: DataFrame, sales: DataFrame, key: str = "area_name_en", tolerance: float = 0.01) -> DataFrame:
    """A metric table's counts and averages against a fresh aggregate of the sales."""
    fresh = sales.groupBy(key).agg(rows().alias("actual_count"), F.avg(PRICE).alias("actual_avg"))
    shown = metric_table.select(key, "total_transactions", "avg_price")
    joined = join_on(shown, fresh, [key])
    ok = (F.col("total_transactions") == F.col("actual_count")) & matches("actual_avg", "avg_price", tolerance)
    return joined.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def reconcile(benchmark: DataFrame, sales: DataFrame) -> DataFrame:
    """Benchmark counts per area and year (area_name_en, year, verified) against the sales."""
    years = F.year("instance_date")
    counted = sales.groupBy(F.col("area_name_en").alias("__area"), years.alias("__year")).agg(rows().alias("current"))
    known = sales.select(F.col("area_name_en").alias("__known")).distinct()
    joined = (
        benchmark.join(counted, (F.col("area_name_en") == F.col("__area")) & (F.col("year") == F.col("__year")), "left")
        .join(known, F.col("area_name_en") == F.col("__known"), "left")
    )
    current = F.coalesce("current", F.lit(0))
    status = (
        F.when(F.col("__known").isNull(), "MISSING_FROM_DATABASE").when(current == F.col("verified"), "MATCH").otherwise("COUNT_MISMATCH")
    )
    return joined.select(
        "area_name_en", "year", "verified", current.alias("current"), (current - F.col("verified")).alias("difference"),
        share(current - F.col("verified"), "verified").alias("difference_pct"), status.alias("status"),
    )


def match_rates(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("year").agg(
        rows().alias("areas"), count_where(F.col("status") == "MATCH").alias("matching"),
        share(count_where(F.col("status") == "MATCH"), rows()).alias("match_rate_pct"),
    )


def revalidate_study(study: DataFrame, sales: DataFrame, key: str, years: Sequence[int], tolerance: float = 0.01) -> DataFrame:
    """Every number of a growth study against one recomputed from the dates of the sales."""
    dated = sales.withColumn("transaction_year", F.date_format("instance_date", "yyyy").cast("int"))
    again = growth_study(dated, key, years)
    exact = [c for c in again.columns if c.startswith(("transactions_", "change_"))]
    loose = [c for c in again.columns if c.startswith(("avg_value_", "growth_")) or c == "compound_growth_pct"]

    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias(value)) for c in (*exact, *loose)])
        return df.select("name", F.explode(pairs).alias("p")).select("name", "p.check", f"p.{value}")

    both = long(study, "expected").join(long(again, "actual"), ["name", "check"], "left")
    expected, actual = F.col("expected"), F.col("actual")
    largest = F.greatest(F.abs(expected), F.abs(actual))
    near = F.abs(expected - actual) <= largest * F.when(F.col("check").isin(*exact), 0.0).otherwise(tolerance)
    infinite = (expected == INFINITE_GROWTH) | (actual == INFINITE_GROWTH)
    passed = F.when((expected == 0) | (actual == 0) | infinite, expected == actual).otherwise(near)
    return both.withColumn("passed", F.coalesce(passed, F.lit(False)))


def study_quality(checks: DataFrame) -> DataFrame:
    return checks.agg(
        rows().alias("checks"), count_where(F.col("passed")).alias("passed"),
        share(count_where(F.col("passed")), rows()).alias("quality_score"),
    )
