"""Labels: votes of cells, reconciled annotators, adjudication by markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import keep_first, mapped


def cluster_scores(votes: DataFrame, flat: str = "zero") -> DataFrame:
    """cluster, label, score: within a cluster, scores go to the range 0 to 1,
    then to weights that sum to 1, and score times weight is summed a label
    (WIN1 to WIN3).

    ``flat``: what a cluster of equal scores gets in the first step, "zero" or
    "uniform" (1 / n; then null scores count as 0, WIN3b).  Otherwise null
    scores take no part in sums but count in equal shares.
    """
    score = F.coalesce("score", F.lit(0.0)) if flat == "uniform" else F.col("score")
    own = votes.where("cluster IS NOT NULL").withColumn("__s", score)
    # a row a cluster: no cluster meets in one task
    ranges = own.groupBy("cluster").agg(F.min("__s").alias("__low"), F.max("__s").alias("__high"), F.count("*").alias("__n"))
    even = 1.0 / F.col("__n") if flat == "uniform" else F.lit(0.0)
    level = F.when(F.col("__high") > F.col("__low"), (F.col("__s") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(even)
    total = own.join(ranges, "cluster").groupBy("cluster").agg(F.sum(level).alias("__t"), F.first("__low").alias("__low"), F.first("__high").alias("__high"), F.first("__n").alias("__n"))
    weight = F.when(F.col("__t") != 0, level / F.col("__t")).otherwise(1.0 / F.col("__n"))
    return own.join(total, "cluster").groupBy("cluster", "label").agg(F.sum(F.col("__s") * weight).alias("score"))


def dominant(scores: DataFrame) -> DataFrame:
    """The label of the highest score a cluster; of equal ones the first in
    alphabetical order (WIN3)."""
    return keep_first(scores.where("label IS NOT NULL"), ["cluster"], [F.desc_nulls_last("score"), F.asc("label")])


def majority(votes: DataFrame) -> DataFrame:
    """The commonest label a cluster, where there are no scores (WIN3c)."""
    return dominant(votes.where("cluster IS NOT NULL").groupBy("cluster", "label").agg(F.count("*").alias("score")))


def with_confidence(chosen: DataFrame, votes: DataFrame) -> DataFrame:
    """The mean score of the cells that voted for the chosen label (WIN3d)."""
    mean = votes.groupBy("cluster", "label").agg(F.avg("score").alias("cluster_confidence"))
    return chosen.join(mean, ["cluster", "label"], "left")


def reconciled(df: DataFrame, a: str, b: str, vocabulary: DataFrame, default: str | None = "unresolved") -> DataFrame:
    """Two annotators through one vocabulary: a_coarse, b_coarse, agreement,
    and the label: the common one, or ``ambiguous:a|b`` (MAP1, MTH6, STA25).
    Two labels without a match agree, on the default."""
    out = mapped(mapped(df, a, vocabulary, "a_coarse", default), b, vocabulary, "b_coarse", default)
    agree = F.col("a_coarse").eqNullSafe(F.col("b_coarse"))
    return out.withColumn("agreement", F.when(agree, "agree").otherwise("disagree")).withColumn("label", F.when(agree, F.col("a_coarse")).otherwise(F.concat(F.lit("ambiguous:"), F.col("a_coarse"), F.lit("|"), F.col("b_coarse"))))


def margin_vote(df: DataFrame, cluster: str, label: str, margin: str) -> DataFrame:
    """cluster, label, confidence: margins, at least 0, summed a cluster and
    label; the highest sum and its share of all (AGG14)."""
    sums = df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.sum(F.greatest(F.col(margin), F.lit(0.0))).alias("score"))
    w = Window.partitionBy("cluster")
    shares = sums.withColumn("confidence", F.coalesce(F.try_divide("score", F.sum("score").over(w)), F.lit(0.0)))
    return dominant(shares)


def agreement_rate(df: DataFrame, a: str, b: str) -> Column:
    """An aggregate: the share of rows with equal labels (STA25)."""
    return F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))


def first_and_size(df: DataFrame, by: str, value: str, order: Column) -> DataFrame:
    """The first value that isn't null and the number of rows a group (AGG15)."""
    return df.groupBy(by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), order)).alias("first_value"), F.count("*").alias("size"))


def gated(label: Column, top: Column, margin: Column, least_top: float = 0.0, least_margin: float = 0.0) -> Column:
    """The label of a marker score, or ambiguous where score or margin is too low (MTH6)."""
    return F.when((top > least_top) & (margin > least_margin), label).otherwise("ambiguous")


def adjudicated(consensus: Column, marker: Column) -> Column:
    """A consensus label as it is; of an ambiguous one, the marker label where it
    is among the choices (STR15)."""
    from ..functions.text import choices

    open_ = consensus.startswith("ambiguous:")
    return F.when(~open_, consensus).when(F.array_contains(choices(consensus), marker), marker).otherwise("unresolved")
