"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Registered] = {}


def register(name: str, sql: str | None = None, r6: str = "", r4: str = "", r2: str = ""):
    """Decorator: adds a query. r6/r4/r2 name the columns both sides round to 6, 4 or 2 places.

    Averages of prices in cents often end exactly half-way between two rounded values, where the
    order of summation would decide. Both sides therefore add a fortieth of the last place first.
    """
    places = {c: n for n, names in ((6, r6), (4, r4), (2, r2)) for c in names.split()}

    def add(build):
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(0.025 * 10.0**-n), n) for c, n in places.items()}) if places else df

        wrapped = sql
        if sql is not None and places:
            shown = ", ".join(f"round(CAST({c} AS DOUBLE) + CAST('{0.025 * 10.0**-n!r}' AS DOUBLE), {n}) AS {c}" for c, n in places.items())
            wrapped = f"SELECT * REPLACE ({shown}) FROM ({sql})"
        if name in REGISTERED:
            raise ValueError(f"query registered twice: {name}")
        REGISTERED[name] = Registered(name, rounded, wrapped)
        return build

    return add


# The sample tables as clean sales, for use as "WITH" prefix. "tx" holds the clean rows.
TX = """
WITH li AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC,
    l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) = 1),
all_tx AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(l_shipdate AS DATE) AS instance_date,
    CASE l_returnflag WHEN 'N' THEN 'Off-Plan' WHEN 'A' THEN 'Existing' ELSE 'Unknown' END AS transaction_type,
    l_linestatus = 'O' AS originally_offplan, l_extendedprice AS actual_worth, l_quantity AS procedure_area,
    l_extendedprice / l_quantity AS meter_sale_price, l_extendedprice >= 95000 AS is_luxury,
    CAST(year(l_shipdate) AS INTEGER) AS transaction_year, CAST(month(l_shipdate) AS INTEGER) AS transaction_month,
    n_name AS area_name_en, s_name AS developer, p_name AS project_name_en, p_type AS property_type,
    (1 + p_size % 7) || ' B/R' AS rooms_en, l_extendedprice >= 2000 AS is_valid,
    CASE WHEN l_extendedprice >= 2000 THEN 1.0 ELSE 0.0 END AS quality_score
  FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
tx AS (SELECT * FROM all_tx WHERE is_valid AND transaction_type <> 'Unknown')
"""
