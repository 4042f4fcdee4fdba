"""Reporting periods. A period is always a half-open date range [start, end)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.functions.expr import col

# Periods per year for each period type.
PER_YEAR = {"monthly": 12, "quarterly": 4, "semi_annual": 2, "annual": 1}


def months_after(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class Period:
    """One reporting period, e.g. Period(2000, "quarterly", 2)."""

    year: int
    kind: str
    number: int = 1

    def __post_init__(self):
        if self.kind not in PER_YEAR:
            raise ValueError(f"unknown period type: {self.kind}")
        if not 1 <= self.number <= PER_YEAR[self.kind]:
            raise ValueError(f"{self.kind} period number out of range: {self.number}")

    @property
    def months(self) -> int:
        return 12 // PER_YEAR[self.kind]

    @property
    def start(self) -> date:
        return date(self.year, (self.number - 1) * self.months + 1, 1)

    @property
    def end(self) -> date:
        return months_after(self.start, self.months)

    @property
    def index(self) -> int:
        return self.year * PER_YEAR[self.kind] + self.number - 1

    def shifted(self, periods: int) -> Period:
        n = PER_YEAR[self.kind]
        index = self.index + periods
        return Period(index // n, self.kind, index % n + 1)

    def previous(self) -> Period:
        """The calendar predecessor, across the turn of the year."""
        return self.shifted(-1)

    def year_before(self) -> Period:
        return self.shifted(-PER_YEAR[self.kind])

    def preceding_window(self) -> tuple[date, date]:
        """The window of equal length in days just before the period."""
        return self.start - (self.end - self.start), self.start

    def contains(self, day: Column | str = "instance_date") -> Column:
        return within(self.start, self.end, day)

    def lookback(self, months: int) -> tuple[date, date]:
        return months_after(self.start, -months), self.start


def within(start: date, end: date, day: Column | str = "instance_date") -> Column:
    """Dates from start up to, not including, end.

    Of sales the stored year is bounded as well: tables are partitioned by it, so only the folders of these years are read.
    """
    inside = (col(day) >= F.lit(start)) & (col(day) < F.lit(end))
    if isinstance(day, str) and day == "instance_date":
        inside = inside & F.col("transaction_year").between(start.year, (end - timedelta(days=1)).year)
    return inside


def period_index(day: Column | str, kind: str) -> Column:
    """Running number of the period a date lies in; neighbours differ by one."""
    day, n = col(day), PER_YEAR[kind]
    return F.year(day) * n + F.floor((F.month(day) - 1) / F.lit(12 // n)).cast("int")


def period_columns(index: Column | str, kind: str) -> list[Column]:
    """Year, number, start and end of a period given its running number."""
    index, n = col(index), PER_YEAR[kind]
    year = F.floor(index / F.lit(n)).cast("int")
    number = F.pmod(index, F.lit(n)) + 1
    start = F.make_date(year, (number - 1) * F.lit(12 // n) + 1, F.lit(1))
    return [
        year.alias("period_year"),
        number.cast("int").alias("period_number"),
        start.alias("period_start"),
        F.add_months(start, 12 // n).alias("period_end"),
    ]


def calendar(spark: SparkSession, first: Period, last: Period) -> DataFrame:
    """One row per period from first to last, so that empty periods appear in a series."""
    rows = spark.range(first.index, last.index + 1).select(F.col("id").cast("int").alias("period_index"))
    return rows.select("period_index", *period_columns("period_index", first.kind))
