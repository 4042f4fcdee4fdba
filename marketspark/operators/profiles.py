"""Profiles of areas and developers, comparisons, and market concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import SEGMENTS
from marketspark.functions.expr import band, clamp, count_where, filled, pct_change, rows, share
from marketspark.functions.periods import within
from marketspark.functions.scale import nearest_by_value, summarise
from marketspark.operators.metrics import PRICE, SQM, mix_within, numbered, offplan, with_total


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None and end is not None:
        return df.where(within(start, end))
    if start is not None:
        return df.where(F.col("instance_date") >= F.lit(start))
    return df if end is None else df.where(F.col("instance_date") < F.lit(end))


def segment_of(price: Column | str, edges: Sequence[float]) -> Column:
    return band(price, edges, SEGMENTS)


def area_profiles(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Key figures and market segment of every area."""
    measured = summarise(
        df,
        ["area_name_en"],
        [
            rows().alias("total_transactions"),
            F.avg(PRICE).alias("avg_price"),
            F.avg(SQM).alias("avg_price_sqm"),
            F.min(PRICE).alias("min_price"),
            F.max(PRICE).alias("max_price"),
            F.avg("procedure_area").alias("avg_unit_size_sqm"),
            share(count_where(offplan()), rows()).alias("offplan_pct"),
            share(count_where(F.col("is_luxury")), rows()).alias("luxury_pct"),
        ],
        distinct={"unique_projects": "project_name_en", "unique_developers": "developer"},
    )
    return measured.withColumn("market_segment", segment_of("avg_price", edges))


def area_mixes(df: DataFrame) -> DataFrame:
    """Share of each property type and of each number of rooms within its area."""
    kinds = mix_within(df, "area_name_en", "property_type", "item").withColumn("mix", F.lit("property_type"))
    rooms = mix_within(df.where(F.col("rooms_en").isNotNull()), "area_name_en", "rooms_en", "item").withColumn("mix", F.lit("rooms"))
    return kinds.unionByName(rooms)


def comparable_areas(df: DataFrame, k: int = 5) -> DataFrame:
    """For each area the k areas nearest in average price, of similar price and number of sales."""
    areas = df.groupBy("area_name_en").agg(rows().alias("tx_count"), F.avg(PRICE).alias("avg_price"))
    return nearest_by_value(areas, "area_name_en", "avg_price", "tx_count", k)


def area_dna(df: DataFrame, edges: Sequence[float], k: int = 5) -> DataFrame:
    """Area profiles with both mixes as maps and the comparable areas, nearest first."""
    mixes = area_mixes(df).groupBy("area_name_en").pivot("mix", ["property_type", "rooms"]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "pct"))))
    )
    names = comparable_areas(df, k).groupBy("area_name_en").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nearness", "comparable"))), lambda s: s["comparable"]).alias("comparable_areas")
    )
    named = mixes.withColumnsRenamed({"property_type": "transaction_mix", "rooms": "room_distribution"})
    return area_profiles(df, edges).join(named, "area_name_en", "left").join(names, "area_name_en", "left")


def compare_pairs(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Given pairs (area_1, area_2): difference in price and activity and a similarity from 0 to 1."""
    shown = profiles.select("area_name_en", "avg_price", "total_transactions", "market_segment")

    def side(n: int) -> DataFrame:
        return shown.select(
            F.col("area_name_en").alias(f"area_{n}"),
            F.col("avg_price").alias(f"price_{n}"),
            F.col("total_transactions").alias(f"transactions_{n}"),
            F.col("market_segment").alias(f"segment_{n}"),
        )

    zero = F.lit(0.0)
    price = F.coalesce(pct_change("price_1", "price_2"), zero)
    volume = F.coalesce(pct_change("transactions_1", "transactions_2"), zero)
    same = F.col("segment_1") == F.col("segment_2")
    similarity = 1 - F.abs(price) / 200 - F.abs(volume) / 200 - F.when(same, 0.0).otherwise(0.2)
    return pairs.join(side(1), "area_1").join(side(2), "area_2").select(
        "area_1",
        "area_2",
        price.alias("price_difference_pct"),
        volume.alias("volume_difference_pct"),
        same.alias("segment_match"),
        clamp(similarity, 0, 1).alias("similarity_score"),
    )


def developer_profiles(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Size, price level, off-plan focus and market share of every developer.

    The market share is of all sales, including those without a developer.
    """
    named = (
        df.where(filled("developer"))
        .groupBy("developer")
        .agg(
            rows().alias("total_transactions"),
            F.avg(PRICE).alias("avg_transaction_value"),
            share(count_where(offplan()), rows()).alias("offplan_pct"),
        )
        .withColumn("market_segment", segment_of("avg_transaction_value", edges))
    )
    total = df.agg(rows()).scalar()
    return named.withColumn("__market", total).withColumn("market_share", share("total_transactions", "__market")).drop("__market")


def developer_areas(df: DataFrame, k: int = 5) -> DataFrame:
    """The k leading areas of every developer."""
    order = Window.partitionBy("developer").orderBy(F.desc("tx_count"), "area_name_en")
    counted = df.where(filled("developer")).groupBy("developer", "area_name_en").agg(rows().alias("tx_count"))
    return counted.withColumn("area_rank", F.row_number().over(order)).where(F.col("area_rank") <= k)


def developer_types(df: DataFrame) -> DataFrame:
    return mix_within(df.where(filled("developer")), "developer", "property_type", "property_type")


def concentration(df: DataFrame, name: str) -> DataFrame:
    """Share of sales of the five and ten largest names, and the names of the five largest."""
    counted = df.where(filled(name)).groupBy(F.col(name).alias("name")).agg(rows().alias("tx_count"))
    order = (F.desc("tx_count"), F.col("name"))
    top = numbered(counted.orderBy(*order).limit(10), *order)
    five = F.col("rank") <= 5
    leaders = F.array_sort(F.collect_list(F.when(five, F.struct("rank", "name"))))
    return (
        top.withColumn("total", counted.agg(F.sum("tx_count")).scalar())
        .groupBy("total")
        .agg(
            F.sum(F.when(five, F.col("tx_count"))).alias("top_5"),
            F.sum("tx_count").alias("top_10"),
            F.array_join(F.transform(leaders, lambda s: s["name"]), ", ").alias("leaders"),
        )
        .select(
            F.lit(name).alias("dimension"),
            F.col("total").alias("total_transactions"),
            share("top_5", "total").alias("top_5_share"),
            share("top_10", "total").alias("top_10_share"),
            "leaders",
        )
    )


def market_concentration(df: DataFrame) -> DataFrame:
    return concentration(df, "area_name_en").unionByName(concentration(df, "developer"))


def segment_distribution(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    counted = df.groupBy(segment_of(PRICE, edges).alias("segment")).agg(rows().alias("tx_count"))
    return with_total(counted, "tx_count", "__total").withColumn("pct", share("tx_count", "__total")).drop("__total")


def area_list(area_metrics: DataFrame, names: Sequence[str], limit: int = 5) -> DataFrame:
    """Metrics of up to five named areas, dearest first."""
    if len(names) > limit:
        raise ValueError(f"at most {limit} areas can be compared")
    return area_metrics.where(F.col("area_name_en").isin(*names)).orderBy(F.desc("avg_price"))
