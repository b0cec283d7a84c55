"""Writers, and stages that are skipped when their result is there."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import dense_ids
from .scratch import stored


def write_matrix(x: DataFrame, folder: str, partition: str = "puck") -> None:
    """A matrix as Parquet, a folder a batch (SNK1)."""
    x.write.mode("overwrite").partitionBy(partition).parquet(folder)


def write_text(df: DataFrame, folder: str, sep: str = "\t", digits: dict[str, int] | None = None) -> None:
    """A text table with a header; columns with digits are rounded (SNK2)."""
    out = df.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in (digits or {}).items()})
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(folder)


def filled(df: DataFrame) -> DataFrame:
    """Null texts as empty ones, numbers untouched (SNK3)."""
    return df.na.fill("", [c for c, k in df.dtypes if k == "string"])


def market_parts(x: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, genes, cells): numbered names and 1-based entries (SNK5)."""
    x = stored(x, "entries")  # both numberings and the entries read it
    genes, cells = stored(dense_ids(x, "gene", "g"), "genes"), stored(dense_ids(x, "cell", "c"), "cells")
    return x.join(genes, "gene").join(cells, "cell").select("g", "c", "value"), genes, cells


def one_file(lines: DataFrame, order: list[str], path: str, part_bytes: int = 16 << 20) -> None:
    """The column ``value`` in the order of some columns as one text file.  Ranges of
    the order are sorted and written by tasks of their own; one task then copies their
    bytes in turn, ``part_bytes`` at a time."""
    spark, parts = lines.sparkSession, f"{path}.parts"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    uri = lambda p: p.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    names = [x.getPath() for x in system.listStatus(hadoop.Path(parts)) if x.getPath().getName().startswith("part-")]
    made = sorted(map(uri, names), key=lambda x: int(x.rsplit("/part-", 1)[1].split("-", 1)[0]))
    system.delete(hadoop.Path(path), True)
    whole = uri(hadoop.Path(path))

    def copied(batches):
        for _ in batches:
            to, at = fs.FileSystem.from_uri(whole)
            with to.open_output_stream(at) as out:
                for one in made:
                    own, name = fs.FileSystem.from_uri(one)
                    with own.open_input_stream(name) as data:
                        while block := data.read(part_bytes):
                            out.write(block)
        yield from ()

    spark.range(0, 1, 1, 1).mapInArrow(copied, "id bigint").collect()
    system.delete(hadoop.Path(parts), True)


def write_market(x: DataFrame, folder: str) -> None:
    """matrix.mtx (banner, size line, entries by cell and gene), genes.tsv and
    barcodes.tsv, each one file, as the format wants (SNK5, SNK9)."""
    entries, genes, cells = market_parts(x)
    entries = stored(entries, "numbered")
    sizes = [df.count() for df in (genes, cells, entries)]
    head = x.sparkSession.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, 1, " ".join(map(str, sizes)))], "part int, c bigint, g bigint, value string")
    body = entries.select(F.lit(1).alias("part"), "c", "g", F.concat_ws(" ", "g", "c", F.col("value").cast("string")).alias("value"))
    one_file(head.unionByName(body), ["part", "c", "g"], f"{folder}/matrix.mtx")
    one_file(genes.select("g", F.col("gene").cast("string").alias("value")), ["g"], f"{folder}/genes.tsv")
    one_file(cells.select("c", F.col("cell").cast("string").alias("value")), ["c"], f"{folder}/barcodes.tsv")


def append_features(spark: SparkSession, folder: str, names: DataFrame) -> None:
    """Genes (column gene) that genes.tsv lacks go to its end, and the size line
    of matrix.mtx counts them; nothing else changes (SNK9)."""
    from . import tables

    own = tables.numbered_lines(spark, f"{folder}/genes.tsv").select(F.col("value").alias("gene"), F.col("k").alias("g"))
    n = own.count()
    new = dense_ids(names.select(F.col("gene").cast("string").alias("gene")).join(own, "gene", "left_anti"), "gene", "g").select("gene", (F.col("g") + n).alias("g"))
    total = n + new.count()
    size = tables.size_line(spark, f"{folder}/matrix.mtx")
    a = F.split(F.trim("value"), r"\s+")
    numbered = tables.numbered_lines(spark, f"{folder}/matrix.mtx")
    first = numbered.where(F.col("value") == size).agg(F.min("k")).first()[0]
    changed = numbered.select(F.when(F.col("k") == first, F.concat_ws(" ", F.lit(total), a[1], a[2])).otherwise(F.col("value")).alias("value"), "k")
    one_file(changed, ["k"], f"{folder}/matrix.new")
    one_file(own.unionByName(new).select("g", F.col("gene").alias("value")), ["g"], f"{folder}/genes.new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for made, name in (("matrix.new", "matrix.mtx"), ("genes.new", "genes.tsv")):
        system.delete(hadoop.Path(f"{folder}/{name}"), True)
        system.rename(hadoop.Path(f"{folder}/{made}"), hadoop.Path(f"{folder}/{name}"))


def stage_path(folder: str, name: str, parameters: dict) -> str:
    """Where a stage's table is kept: the name and a digest of its parameters, so
    that other parameters never find it (SNK7)."""
    return f"{folder}/{name}-{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]}"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (SNK6)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def staged(spark: SparkSession, folder: str, name: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table, made only if it isn't there (SNK7, SNK8)."""
    path = stage_path(folder, name, parameters)
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
