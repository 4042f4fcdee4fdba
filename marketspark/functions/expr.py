"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(new: Column | str, old: Column | str) -> Column:
    """Percentage change; NULL where the base is zero or missing."""
    new, old = col(new).cast("double"), col(old).cast("double")
    return F.try_divide(new - old, old) * 100.0


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage of a whole; NULL where the whole is zero."""
    return F.try_divide(col(part).cast("double") * 100.0, col(whole).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(c)))


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open band [edge, next edge) a value lies in; NULL stays NULL."""
    value = col(c)
    expr = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        expr = expr.when(value < edge, F.lit(label))
    return expr.otherwise(F.lit(labels[len(edges)]))


def lookup(c: Column | str, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed table, or the default when the key is not in it."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, default)


def rank_of(c: Column | str, order: Sequence[str]) -> Column:
    """Position of a label in a fixed order, for custom sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), col(c))


def filled(c: Column | str) -> Column:
    """True where a text value is neither NULL nor empty."""
    return col(c).isNotNull() & (col(c) != "")


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c), "MONTH")


def quarter_start(c: Column | str) -> Column:
    return F.trunc(col(c), "QUARTER")


def quarter_index(year: Column, quarter: Column) -> Column:
    """Running number of a quarter, so that order and distance are arithmetic."""
    return year * 4 + quarter - 1


def without_nan(c: Column | str) -> Column:
    """NULL in place of NaN and infinities."""
    value = col(c)
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)


def fixed(c: Column | str, places: int) -> Column:
    """A number as text with a fixed number of places, at any size; the same in every engine."""
    return col(c).cast(f"decimal({20 + places},{places})").cast("string")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(0.0)))


def avg_where(condition: Column, value: Column | str) -> Column:
    return F.avg(F.when(condition, col(value)))


def rows() -> Column:
    return F.count(F.lit(1))
