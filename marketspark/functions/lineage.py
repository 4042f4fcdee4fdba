"""Sharing one result among several jobs so that it survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    Where it is unset, a local session takes a folder of its own and a cluster one in its warehouse, which is shared too.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        local = context.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="marketspark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: later jobs read columns of it and no lineage is left."""
    path = f"{shared_folder(df.sparkSession)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
