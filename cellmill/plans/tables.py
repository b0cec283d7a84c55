"""The driver's tables in the roles of the domain's.

matrix: order by part, quantities summed; cells are orders, their batch the
order status, genes are parts.  Votes come from events, variants from orders
and line items, sequences from letters of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of a text stand for bases.
LETTERS, LETTER_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value"""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, puck, depth, x, y"""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("puck"), F.col("o_totalprice").alias("depth"), (F.col("o_custkey") % 997).cast("double").alias("x"), (F.col("o_orderkey") % 1009).cast("double").alias("y"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, name, mt, ribo"""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("name"), (F.col("p_size") <= 5).alias("mt"), (F.col("p_size") > 45).alias("ribo"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, cluster, label, score"""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell"), (F.col("user_id") % 40).cast("string").alias("cluster"), F.col("event_type").alias("label"), F.col("value").alias("score"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cb, ub, taxid"""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 100).alias("cb"), (F.col("event_id") % 7).alias("ub"), F.col("event_type").alias("taxid"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ref, alt, context: every three letters in a row of each whole
    document as bases; the second is the reference, the third what it became."""
    d = table(spark, sf_dir, "documents")
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, LETTER_BASES)
    # letters are ASCII now: bytes are found by their place, characters only by a walk
    some = d.select(F.col("doc_id").alias("site"), letters.cast("binary").alias("a")).where(F.length("a") >= 3)
    three = some.select("site", "a", F.explode(F.sequence(F.lit(1), F.length("a") - 2)).alias("k")).select("site", F.substring("a", F.col("k"), F.lit(3)).cast("string").alias("context"))
    return three.select("site", F.substring("context", 2, 1).alias("ref"), F.substring("context", 3, 1).alias("alt"), "context")


def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, context (0 to 95), n: a small count matrix of suppliers by classes."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 96).cast("int").alias("context")).agg(F.count("*").alias("n"))


def signature_share(context: Column, signature: int) -> Column:
    """A made-up signature over 96 classes that sums to 1."""
    k = signature + 2
    weights = [1 + (c * k) % 7 for c in range(96)]
    return (1 + (context * k) % 7) / float(sum(weights))


def signatures(spark: SparkSession, n: int = 4) -> DataFrame:
    """context, signature, h"""
    rows = spark.range(96).select(F.col("id").cast("int").alias("context"))
    out = None
    for s in range(n):
        own = rows.select("context", F.lit(f"S{s}").alias("signature"), signature_share(F.col("context"), s).alias("h"))
        out = own if out is None else out.unionByName(own)
    return out
