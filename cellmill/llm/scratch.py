"""Scratch tables in the folder that every executor shares.

The cluster names that folder in ``spark.checkpoint.dir``.  Where the setting
is absent and Spark runs in one process (tests, notebooks), a local folder is
made once per session; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="cellmill-")
        named = _LOCAL[app]
    if "://" not in named:
        named = f"file://{named.removeprefix('file:')}"
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """URI of a folder of that name which no other call gets."""
    return f"{shared_dir(spark)}/cellmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and return the table.

    This cuts the lineage: what is read later survives the loss of any
    executor, and no upstream work is repeated.
    """
    spark = df.sparkSession
    path = path or new_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a scratch table that :func:`written` returned and nothing needs."""
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/cellmill/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
