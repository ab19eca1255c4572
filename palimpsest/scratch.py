"""Tables and folders of a run in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; on one machine, where none is set, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="palimpsest-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever reads it, and safe from lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
