"""Readers of the file formats of count, barcode, variant and taxon tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARCODES = "observed_barcode string, corrected_barcode string, x double, y double"
BED = "chrom string, start bigint, end bigint"


def digital_expression(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """cell, gene, value of a gene by barcode text file, zeros left out (SRC1).

    The header is one line; each other line is cut into an array in the JVM, so
    a table of any width never becomes columns.  Barcodes that repeat are
    summed, as are genes.
    """
    lines = spark.read.text(path)
    header = lines.limit(1).first()
    if header is None:
        return spark.createDataFrame([], "cell string, gene string, value double")
    names = F.split(F.lit(header[0]), sep)
    cells = F.split("value", sep)
    body = lines.where(F.col("value") != F.lit(header[0])).select(cells[0].alias("gene"), F.posexplode(F.slice(cells, F.lit(2), F.size(cells))).alias("k", "v"))
    values = body.select(F.get(names, F.col("k") + 1).alias("cell"), "gene", F.col("v").try_cast("double").alias("value"))
    return values.where("value <> 0").groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def barcode_matching(spark: SparkSession, path: str) -> DataFrame:
    """Observed and corrected barcodes with their place, without header (SRC2);
    seq is the order in the file, which says what a first row is (DED1)."""
    return spark.read.csv(path, sep="\t", schema=BARCODES).withColumn("seq", F.monotonically_increasing_id())


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    """A text table of a stated schema (SRC3, SRC9, SRC13)."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    return reader.schema(schema).csv(path)


def commented(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A text table whose header line begins with #; all columns text (SRC4)."""
    head = spark.read.text(path).where(F.col("value").startswith("#")).limit(1).first()
    if head is None:
        raise ValueError(f"{path} has no header line")
    names = head[0].lstrip("#").split(sep)
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("sep", sep).option("comment", "#").csv(path)


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Positional variant lines: without those that begin with # or Chr, and
    those of fewer than ten fields (SRC5)."""
    a = F.split("value", "\t")
    good = spark.read.text(path).where(~F.col("value").rlike("^(#|Chr)")).where(F.size(a) >= 10)
    return good.select(a[0].alias("chrom"), a[1].try_cast("long").alias("start"), a[3].alias("ref"), a[4].alias("alt"), a[5].alias("filter"), a[7].alias("up_context"), a[8].alias("down_context"))


def sniffed(spark: SparkSession, path: str, needed: list[str], least_bytes: int = 20) -> DataFrame | None:
    """A text table whose separator the first line tells, comma before tab; None
    for a file that is too small or lacks a column (SRC6)."""
    files = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length").alias("n")).first()
    if not files["n"] or files["n"] < least_bytes:
        return None
    line = spark.read.text(path).limit(1).first()[0]
    sep = "," if "," in line else "\t"
    names = line.split(sep)
    if set(needed) - set(names):
        return None
    return spark.read.option("header", True).option("sep", sep).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, k: the lines of a file, or of a folder's files in the order of their
    names, numbered from 1.  Blocks of files are numbered by themselves, after
    the sizes of those before them; the driver gets a size a block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    before, starts = 0, []
    for r in sorted(lines.groupBy("f", "b").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["f"], r["b"])):
        starts.append((r["f"], r["b"], before))
        before += r["n"]
    first = {(f, b): n for f, b, n in starts}

    def numbered(batches):
        # a task reads a block from its first line to its last, so lines are counted as they come
        open_, k = None, 0
        for batch in batches:
            files, at = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            names, code = files.dictionary.to_pylist(), files.indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(at) != 0)]) if len(at) else []
            for i, j in zip(new, [*new[1:], len(at)], strict=True):
                block = (names[code[i]], int(at[i]))
                if block != open_:
                    open_, k = block, first[block]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.arange(k + 1, k + 1 + j - i))], names=["value", "k"])
                k += j - i

    return lines.mapInArrow(numbered, "value string, k bigint")


def size_line(spark: SparkSession, path: str) -> str:
    """The first line of a coordinate matrix that is no comment; a read of the
    first file's beginning."""
    first = sorted(spark.read.text(path).inputFiles())[0]
    found = spark.read.text(first).where(~F.col("value").startswith("%")).limit(1).first()
    if found is None:
        raise ValueError(f"{path} has no size line")
    return found[0]


def market_matrix(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """cell, gene, value of a matrix.mtx with barcodes.tsv and genes.tsv (SRC7).

    Entries are read in parallel.  The size line is left out by what it says;
    an entry that says the same is put back (entries are unique).
    """
    names = lambda name, k, out: numbered_lines(spark, f"{folder}/{name}{suffix}").select(F.split("value", "\t")[0].alias(out), F.col("k").alias(k))
    path = f"{folder}/matrix.mtx{suffix}"
    size = size_line(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    body = lines.where(F.col("value") != size)
    if lines.where(F.col("value") == size).count() > 1:
        body = body.unionByName(spark.createDataFrame([(size,)], "value string"))
    a = F.split(F.trim("value"), r"\s+")
    entries = body.select(a[0].try_cast("long").alias("g"), a[1].try_cast("long").alias("c"), a[2].try_cast("double").alias("value")).where("value <> 0")
    return entries.join(names("genes.tsv", "g", "gene"), "g").join(names("barcodes.tsv", "c", "cell"), "c").select("cell", "gene", "value")


def annotated(spark: SparkSession, folder: str, part: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a stored matrix: x, obs or var; only the columns asked for are
    read (SRC8)."""
    df = spark.read.parquet(f"{folder}/{part}")
    return df.select(*columns) if columns else df


def taxonomy(spark: SparkSession, path: str, whitespace: bool = False) -> DataFrame:
    """pct, reads, tax_reads, rank, taxid, name of an inspection listing, cut at
    tabs (SRC10) or at white space with the name's words joined by one blank
    (SRC11)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    a = F.split(F.trim("value"), r"\s+") if whitespace else F.split("value", "\t")
    name = F.array_join(F.slice(a, F.lit(6), F.size(a)), " ") if whitespace else F.trim(a[5])
    return lines.where(F.size(a) >= 6).select(F.trim(a[0]).try_cast("double").alias("pct"), F.trim(a[1]).try_cast("long").alias("reads"), F.trim(a[2]).try_cast("long").alias("tax_reads"), a[3].alias("rank"), a[4].alias("taxid"), name.alias("name"))


def with_sample(df: DataFrame, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """``df`` with the sample that its file's path names (SRC13)."""
    return df.withColumn("sample", F.regexp_extract(F.input_file_name(), pattern, 1))


def series(tables: dict[str, DataFrame], alias: str = "run_alias") -> DataFrame:
    """Tables of several series one below the other, with series_id; aliases cut
    at the first underscore (SRC14)."""
    out = None
    for name, df in sorted(tables.items()):
        own = df.withColumn("series_id", F.lit(name))
        if alias in df.columns:
            own = own.withColumn(alias, F.substring_index(alias, "_", 1))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
