"""Numbers of distinct names over periods from mergeable bitmaps.

Every name of an attribute (project, developer, ...) gets an id from 0 on. A cell is an area in a month: for each attribute
it holds, per 32768 ids, a bitmap of the names that occur in its sales. A quarter, a year or the whole market is the
union of its months' and areas' bitmaps and its number of names the number of set bits, so counts of any periods come
from the cells alone, exactly, without reading a sale. New sales merge into the cells by the same union: names already known keep
their ids and new ones follow them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from marketspark.functions.lineage import shared
from marketspark.functions.periods import PER_YEAR
from marketspark.functions.scale import ranked_in_order

CELL = ("area_name_en", "transaction_year", "transaction_month")
COUNTED = {"unique_areas": "area_name_en", "unique_projects": "project_name_en", "unique_developers": "developer"}


def _named(sales: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """The distinct (cell, attribute, name) of sales; null names are none."""
    entries = [F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("name")) for a, c in attributes.items()]
    return sales.select(*CELL, F.explode(F.array(*entries)).alias("e")).select(*CELL, "e.*").where(F.col("name").isNotNull()).distinct()


def dictionary(sales: DataFrame, attributes: Mapping[str, str] = COUNTED, known: DataFrame | None = None) -> DataFrame:
    """attribute, name and id of all names of the sales, ids from 0 on without gaps; names in `known` keep theirs and stay in.

    Written once, so that all cells are built with the same ids.
    """
    names = _named(sales, attributes).select("attribute", "name").distinct()
    if known is not None:
        names = names.join(known.select("attribute", "name"), ["attribute", "name"], "left_anti")
    new = ranked_in_order(names, ["attribute"], [F.col("name").asc()], "place").withColumn("id", F.col("place").cast("long") - 1).drop("place")
    if known is None:
        return shared(new.select("attribute", "name", "id"))
    used = known.groupBy("attribute").agg(F.count(F.lit(1)).alias("used"))
    new = new.join(used, "attribute", "left").withColumn("id", F.col("id") + F.coalesce("used", F.lit(0)))
    return shared(known.select("attribute", "name", "id").unionByName(new.select("attribute", "name", "id")))


def month_cells(sales: DataFrame, names: DataFrame, attributes: Mapping[str, str] = COUNTED) -> DataFrame:
    """area, year, month, attribute, bucket and bits: the cells of sales, with the ids of a dictionary that holds all their names."""
    coded = _named(sales, attributes).join(names, ["attribute", "name"])
    bucket, bit = F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit")
    return coded.select(*CELL, "attribute", bucket, bit).groupBy(*CELL, "attribute", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(*cells: DataFrame) -> DataFrame:
    """Cells of several loads as one."""
    every = cells[0]
    for more in cells[1:]:
        every = every.unionByName(more)
    return every.groupBy(*CELL, "attribute", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(cells: DataFrame, keys: Sequence[str] = (), kind: str | None = None, attributes: Sequence[str] = tuple(COUNTED)) -> DataFrame:
    """keys, period_index (where a kind of period is given) and the number of distinct names of each attribute.

    `keys` is the area or nothing. Unions combine before the shuffle. Periods and areas without sales have no row.
    """
    keys = list(keys)
    if kind is not None:
        n = PER_YEAR[kind]
        index = F.col("transaction_year") * n + F.floor((F.col("transaction_month") - 1) / F.lit(12 // n)).cast("int")
        cells, keys = cells.withColumn("period_index", index.cast("int")), [*keys, "period_index"]
    whole = cells.groupBy(*keys, "attribute", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return whole.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("attribute") == a, F.col("n"))), F.lit(0)).alias(a) for a in attributes])
