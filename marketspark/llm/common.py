"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of the word rule [^\x20\x09-\x0D]+ .
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    spark.checkpoint.dir names it. Where it is unset, a local session gets a folder of its own and a cluster
    uses its warehouse, which is shared as well.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="llm-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written once to the shared folder and read back, so that its lineage ends there.

    A lost executor costs the tasks of the next step only, and ids that depend on the partition stay as written.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null, with the columns of the left side named once."""
    right = right.withColumnsRenamed({c: f"{c}__r" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return left.join(right, same, how).drop(*[f"{c}__r" for c in on])


def joined_spread(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """The same join for a left side in which one key may hold a large part of all rows.

    `right` must be stored. Its size is checked: up to 8 MB it is broadcast, beyond that its rows are copied to 32
    salts over which the rows of every key on the left are dealt.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in right.columns), F.lit(32))
    if (right.agg(F.sum(size)).first()[0] or 0) <= 8 << 20:
        return joined(left, F.broadcast(right), on, how)
    salts = 32
    # By a hash of the row, not at random: a task that runs again deals every row as it did before.
    left = left.withColumn("salt__", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return joined(left, right, [*on, "salt__"], how).drop("salt__")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver did, whatever folder the driver was started in.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. Plain lower() is the same for texts without other letters, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def line_hash(line: Column) -> list[Column]:
    """128 bits of a text as two longs."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def hash_lists(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hashes (h1, h2; each once per key) of every key as `hashes`, a list of short lists that `is_listed` looks into.

    Hashes are dealt by h1 to as many lists as there are eights of them, empty ones included, so that one look costs the
    same for a key with ten hashes and one with a million.
    """
    every = rows.groupBy(*keys).agg(F.collect_list(F.struct("h1", "h2")).alias("every"))
    every = every.withColumn("of", F.ceil(F.size("every") / 8).cast("int"))
    # Null marks every list, so that none is missing.
    marks = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda i: F.struct(i.alias("place"), F.lit(None).cast("struct<h1:bigint,h2:bigint>").alias("hash")))
    dealt = F.transform("every", lambda x: F.struct(F.pmod(x["h1"], F.col("of")).cast("int").alias("place"), x.alias("hash")))
    lists = every.select(*keys, F.inline(F.concat(marks, dealt))).groupBy(*keys, "place").agg(F.collect_list("hash").alias("part"))
    return lists.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]).alias("hashes"))


def is_listed(hashes: Column, h1: Column, h2: Column) -> Column:
    """Whether a hash stands in `hashes` (not null)."""
    return F.array_contains(F.get(hashes, F.pmod(h1, F.size(hashes)).cast("int")), F.struct(h1.alias("h1"), h2.alias("h2")))
