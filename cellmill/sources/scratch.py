"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, which executors share;
    where that is unset and Spark runs in one process, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/cellmill-{spark.sparkContext.applicationId}"
    return f"{shared.rstrip('/')}/cellmill-files/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read from there: what uses it several times
    repeats no work, and lost executors cost no more than a read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
