"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins and partition sizes are planned again at run time; skewed join keys are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # "First row per key" filters run before the shuffle up to this row number (newest_per_key, top lists).
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Groups with percentile or list buffers that a hash aggregate holds before it sorts instead; the buffers are bounded
    # by functions.scale.SMALL_GROUP, by the parts of every list and, where these become one text, by the text.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1000",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "marketspark", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. On a cluster leave master and shuffle_partitions to spark-submit:
    some two to three partitions per core, and as many as keep one below 200 MB."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
