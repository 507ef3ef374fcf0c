"""Folders for checkpoints and sink files that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder; only a local session without one gets a temporary folder."""
    found = spark.conf.get(_SETTING, "") or spark.sparkContext.getConf().get(_SETTING, "")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, found)
    return f"{found.rstrip('/')}/barlake-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh path of the shared folder and read again: later actions start from there."""
    path, schema = new_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
