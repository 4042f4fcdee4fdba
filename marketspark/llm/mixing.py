"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source the keys are range-sorted: keys are uniform, so ranges of
equal width hold nearly equal numbers of rows and no sampling pass is needed. Sums per range, their running sum
over the ranges of a source and running sums inside each range are the prefix sums of the source, and no source
is ever in one task, however hot. Each source is cut at its exact budget: whole epochs first, then the rows
before the cut once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import joined, joined_spread, settled, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 20_000
KEY_BITS = 60
SEED = "mix"


def hash_key(seed: str, *parts: Column) -> Column:
    """A uniform number of 60 bits; the same for the same parts in every run."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def prefix_sums(rows: DataFrame, by: str, key: str, amount: str, ranges: int) -> DataFrame:
    """Rows (by, key, amount), each pair of by and key once, with `before`: the sum over the smaller keys of the group."""
    rows = rows.withColumn("range", F.floor(F.col(key) / ((1 << KEY_BITS) // ranges + 1)).cast("int"))
    earlier = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(by, "range").agg(F.sum(amount).alias("sum"))  # as many rows as ranges in a group
    offsets = offsets.select(by, "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(by, "range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return joined(rows, offsets, [by, "range"]).withColumn("before", F.col("inside") + F.col("offset")).drop("range", "inside", "offset")


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """The rows with `place`, 0 on, in the order of a column with null last; ordered by range, so in no single task."""
    parts = settled(rows.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())) - 1
    return parts.withColumn("inside", inside).join(offsets, "part").withColumn("place", F.col("inside") + F.col("offset")).drop("part", "inside", "offset")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Rows (source, source_size) with `target`.

    Weights repeat over the sources by code point, null last. The targets share `share` of all sizes by weight;
    one above `most` times its source's size stops there and the excess is shared again by weight until none is
    above. Three sums of each round reach the driver.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("place") % len(weights)).cast("int")]
    rows = settled(numbered(sources, "source").withColumn("weight", weight).withColumn("top", F.col("source_size") * float(most)), "mix-sources")
    full = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, None
    while True:
        above = F.col("top") <= F.lit(level) * F.col("weight")
        n, used, still = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("top"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not still:
            break
        stopped, level = n, (full - (used or 0.0)) / still
    target = F.when(F.col("top") <= F.lit(level) * F.col("weight"), F.col("top")).otherwise(F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", F.round(target, 6).alias("target"))


def cuts(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Per source of the rows (source, key, size): source_size, target, whole epochs, and the cut of the last epoch.

    Rows with a key below cut_key are taken once more; the cut_rows rows at cut_key, cut_size words together, give
    cut_rest words. Rows of one source with equal keys are repeated rows and are summed first.
    """
    plan = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = settled(plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-plan")
    ranges = max(1, keyed.count() // ROWS_PER_RANGE)
    single = keyed.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    placed = joined_spread(prefix_sums(single, "source", "key", "size", ranges), plan.select("source", "rest"), ["source"])
    at = placed.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    at = at.select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.col("rows").alias("cut_rows"), (F.col("rest") - F.col("before")).alias("cut_rest"))
    return settled(joined(plan.drop("rest"), at, ["source"], "left"), "mix-cuts")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; 0 for null) and key of every row of documents."""
    size = word_count(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")).withColumn("key", hash_key(SEED, F.col("doc_id"), F.col("size")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of documents (doc_id, text, source).

    The cut is exact: of the document that crosses the budget only the words up to it count. Rows that repeat an
    id and a size are taken alike. Null sources are one source, the last. Null and blank texts have size 0 and
    take nothing; a source without words has target 0. An empty table gives no rows.
    """
    keyed = settled(keyed_rows(docs), "mix-keys")
    at = joined_spread(keyed, cuts(keyed, weights, share, most), ["source"])
    last = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.floor(F.col("cut_rest") / F.col("cut_rows"))).otherwise(0)
    return at.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """The rows of documents as often as the mix takes them, whole and with all their columns.

    The document that crosses a budget is taken if at least half of it lies within.
    """
    cut = cuts(settled(keyed_rows(docs).select("source", "key", "size"), "mix-keys"), weights, share, most)
    cut = cut.select("source", "epochs", "cut_key", (F.col("cut_rest") * 2 >= F.col("cut_size")).alias("cut_in"))
    size = word_count(F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", hash_key(SEED, F.col("doc_id").cast("long"), size).alias("key"))
    once_more = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & F.col("cut_in")), F.lit(False))
    copies = (F.col("epochs") + once_more.cast("int")).cast("int")
    taken = joined_spread(rows, cut, ["source"]).withColumn("copies", copies).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("doc.*")
