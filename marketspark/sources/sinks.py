"""Writers. Tables are directories of Parquet files; replacing one is an overwrite of its directory."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from marketspark.config import INFINITE_GROWTH
from marketspark.functions.expr import fixed
from marketspark.sources.readers import POINTER, POINTER_SCHEMA, latest_snapshot


def stamped(df: DataFrame, version_id: int) -> DataFrame:
    return df.withColumns({"version_id": F.lit(version_id), "imported_at": F.current_timestamp()})


def append_version(df: DataFrame, path: str, version_id: int) -> None:
    """Adds a validated version, or replaces it where it was added before; readers of one version open only its directory."""
    year = [c for c in ("transaction_year",) if c in df.columns]
    # The version is a folder of its own, so a repeated load overwrites it and no other.
    stamped(df, version_id).drop("version_id").write.mode("overwrite").partitionBy(*year).parquet(f"{path}/version_id={version_id}")


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def commit_table(df: DataFrame, path: str) -> str:
    """Replaces a table at once and returns the name of its new snapshot; readers.read_table reads it.

    The rows go to a folder of their own, and only when that is complete one row added to the pointer names it. A rewrite
    that fails leaves the table as it was, and a reader keeps the snapshot it began with. A frame that reads the
    table itself may be committed to it. Of two writers the later pointer counts.
    """
    spark = df.sparkSession
    number = latest_snapshot(spark, path)[0] + 1
    name = f"snapshot-{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("snapshot"), F.current_timestamp().alias("committed_at"))
    spark.createDataFrame([], POINTER_SCHEMA).unionByName(row).coalesce(1).write.mode("append").parquet(f"{path}/{POINTER}")
    return name


def bucketed_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Stores a table under a name of the catalog, one sorted file per bucket of its keys, and returns it.

    A look-up by all keys reads one bucket, and tables with the same buckets join without an exchange. For tables with few
    rows per key, such as metric tables. A session with another catalog opens it by readers.open_bucketed.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def marked_infinite(c: str) -> Column:
    """Growth as text with two places, with the zero-base marker spelled out."""
    return F.when(F.col(c) == INFINITE_GROWTH, F.lit("INFINITE")).otherwise(fixed(c, 2)).alias(c)


def shown_study(study: DataFrame) -> DataFrame:
    """A growth study as it is published."""
    growth = [c for c in study.columns if c.startswith(("growth_", "compound_growth_"))]
    return study.select(*[marked_infinite(c) if c in growth else F.col(c) for c in study.columns])


def export_study_json(study: DataFrame, path: str) -> None:
    shown_study(study).write.mode("overwrite").json(path)


def export_slices(slices: dict[str, DataFrame], path: str) -> None:
    """One directory of CSV files per named slice."""
    for name, df in slices.items():
        export_csv(df, f"{path}/{name}")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows cast to a declared schema; a value that does not fit fails the load."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def truncate_load(df: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """Replaces a table with rows of a declared schema and returns (expected, written) row counts."""
    # The rows are counted while they are written, so the source is read once.
    seen = Observation()
    replace_table(typed(df, schema).observe(seen, F.count(F.lit(1)).alias("expected_rows")), path)
    written = df.sparkSession.read.schema(schema).parquet(path).agg(F.count(F.lit(1)).alias("written_rows"))
    return written.select(F.lit(seen.get["expected_rows"]).cast("long").alias("expected_rows"), "written_rows")
