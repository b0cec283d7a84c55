"""Checks that a step kept what it should keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import like_integer


def conservation(before: DataFrame, after: DataFrame, key: str, value: str = "value") -> DataFrame:
    """n_before, n_after and the largest relative difference of totals a key; 0
    where there is no key (AGG23)."""
    rows = before.groupBy(key).agg(F.sum(value).alias("a"), F.lit(0).alias("b")).unionByName(after.groupBy(key).agg(F.lit(0).alias("a"), F.sum(value).alias("b")))
    both = rows.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(F.count_if(F.col("a") != 0).alias("n_before"), F.count_if(F.col("b") != 0).alias("n_after"), F.coalesce(F.max(F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a"), F.lit(1))), F.lit(0.0)).alias("max_diff"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_keys and n_duplicates (AGG24)."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def integer_share(df: DataFrame, value: str) -> DataFrame:
    """n_nonzero and the share of whole numbers among all values that aren't 0;
    is_raw beyond 99.9 % (MTH5)."""
    some = df.where(F.col(value) != 0)
    return some.agg(F.count("*").alias("n_nonzero"), F.avg(like_integer(F.col(value)).cast("double")).alias("integer_share")).withColumn("is_raw", F.coalesce(F.col("integer_share") > 0.999, F.lit(False)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_lost and n_new: rows of a that b lacks and the other way, repeats
    counted (SNK12)."""
    left = a.exceptAll(b).select(F.lit(1).alias("lost"), F.lit(0).alias("new"))
    right = b.exceptAll(a).select(F.lit(0).alias("lost"), F.lit(1).alias("new"))
    return left.unionByName(right).agg(F.coalesce(F.sum("lost"), F.lit(0)).cast("long").alias("n_lost"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_new"))


def counters(df: DataFrame, **conditions) -> DataFrame:
    """One row with the number of rows of each condition (AGG25)."""
    return df.agg(F.count("*").alias("n_total"), *(F.count_if(c).alias(f"n_{n}") for n, c in conditions.items()))
