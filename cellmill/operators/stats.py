"""Ranks, tests and correlations over groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .qc import exact_percentiles


def two_sided_p(z: Column) -> Column:
    """erfc(|z| / sqrt 2), by a continued fraction for large arguments and a
    series for small ones, in expressions of Spark alone (relative error under
    1e-12)."""
    x = F.abs(z) / math.sqrt(2)
    # series: erf(x) = 2/sqrt(pi) * exp(-x*x) * x * (1 + y/3 * (1 + y/5 * (1 + ...))), y = 2*x*x
    # fraction: erfc(x) = exp(-x*x)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
    small, large = F.lit(1.0), x
    for n in range(60, 0, -1):
        small = 1.0 + 2.0 * x * x / float(2 * n + 1) * small
        large = x + (n / 2.0) / large
    return F.when(x < 2.5, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * small).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / large)


def running(df: DataFrame, by: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """``df`` with __part (the range of a group's rows by ``order[0]`` that a row
    falls into), __row (its place in the range, by all of ``order``) and __before
    (the rows of the group in the ranges before).

    A sketch a group chooses the edges of the ranges, so that a group of any size
    is ordered by many tasks; equal values lie in one range, and so do nulls.
    """
    first = order[0]
    edges = df.groupBy(*by).agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 1000).alias("__e"))
    placed = df.join(edges, by).withColumn("__part", F.coalesce(F.size(F.filter("__e", lambda e: e < F.col(first))), F.lit(-1))).drop("__e")
    sizes = placed.groupBy(*by, "__part").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a group
    before = sizes.select(*by, "__part", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"))
    return placed.join(before, [*by, "__part"]).withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))


def cumulative_distribution(df: DataFrame, value: str, by: list[str], out: str = "ecdf") -> DataFrame:
    """The share of a group's rows with this value or a smaller one (WIN6)."""
    ranked = running(df, by, [value])
    total = df.groupBy(*by).agg(F.count("*").alias("__m"))
    last = F.max("__row").over(Window.partitionBy(*by, "__part", value))
    return ranked.withColumn("__r", F.col("__before") + last).join(total, by).withColumn(out, F.col("__r") / F.col("__m")).drop("__part", "__row", "__before", "__r", "__m")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], key: str, out: str = "p_adj", parts: int = 64) -> DataFrame:
    """Adjusted p-values within groups: p * m / rank, the running minimum from
    the largest down, 1 at most (STA13).  A null p stays null and isn't counted.

    Equal p-values get one adjusted value, that of their last rank, whatever the
    ``key``; so each is counted once, however many tests share it, and a group's
    distinct values are ordered range by range.  Sizes and minima of the other
    ranges are a list of ``parts`` entries a group.
    """
    tests = stored(df, "tests")
    values = tests.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__k"))
    edges = values.groupBy(*by).agg(F.percentile_approx(p, [k / parts for k in range(1, parts)], 1000).alias("__e"))
    placed = values.join(edges, by).withColumn("__part", F.size(F.filter("__e", lambda e: e < F.col(p)))).drop("__e")
    beside = lambda rows, what: rows.groupBy(*by, "__part").agg(what.alias("__v")).groupBy(*by).agg(F.collect_list(F.struct("__part", "__v")).alias("__held"))
    sizes = beside(placed, F.sum("__k")).withColumn("__m", F.aggregate("__held", F.lit(0).cast("long"), lambda n, h: n + h["__v"]))
    lower = F.aggregate(F.filter("__held", lambda h: h["__part"] < F.col("__part")), F.lit(0).cast("long"), lambda n, h: n + h["__v"])
    own = F.sum("__k").over(Window.partitionBy(*by, "__part").orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    ranked = stored(placed.withColumn("__upto", own).join(sizes, by).select(*by, p, "__part", (F.col(p) * F.col("__m") / (F.col("__upto") + lower)).alias("__q")), "ranked")
    later = F.array_min(F.transform(F.filter("__held", lambda h: h["__part"] > F.col("__part")), lambda h: h["__v"]))
    least = F.min("__q").over(Window.partitionBy(*by, "__part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    done = ranked.withColumn("__least", least).join(beside(ranked, F.min("__q")), by).select(*by, p, F.least(F.lit(1.0), "__least", later).alias(out))
    return tests.join(done, [*by, p], "left")


def rank_sums(x: DataFrame, groups: DataFrame, gene: str = "gene", cell: str = "cell", value: str = "value", group: str = "grp", parts: int = 64, one_range: int = 10_000) -> DataFrame:
    """Wilcoxon rank sums of each group against the rest, a row a gene and group:
    n_in, n_out, rank_sum, z (no correction for ties), log_fold_change, pct_in
    and pct_out (STA12).

    ``x`` holds log-normalised values without zeros, ``groups`` a row a cell.
    The n0 zeros of a gene share the rank (n0 + 1) / 2 and lift all others by
    n0, so ranks are made of the stored values alone.  Equal values of a gene and
    group are counted once, and a gene of more than ``one_range`` of them is ranked
    in ``parts`` ranges, each by a task of its own; a range's place is known from
    the sizes of the others.  Rows without a gene take no part.
    """
    sizes = groups.groupBy(group).agg(F.count("*").alias("n_in")).collect()  # names of groups
    total = sum(r["n_in"] for r in sizes)
    tied = stored(x.where((F.col(value) > 0) & F.col(gene).isNotNull()).join(groups, cell).groupBy(gene, value, group).agg(F.count("*").alias("__k")), "tied")
    large = tied.groupBy(gene).agg(F.count("*").alias("__c")).where(F.col("__c") > one_range).select(gene)
    edges = tied.join(large, gene, "left_semi").groupBy(gene).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000).alias("__e"))
    range_ = F.when(F.col("__e").isNull(), 0).otherwise(F.size(F.filter("__e", lambda e: e < F.col(value))))
    placed = tied.join(edges, gene, "left").withColumn("__part", range_).drop("__e")
    upto = F.sum("__k").over(Window.partitionBy(gene, "__part").orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum("__k").over(Window.partitionBy(gene, "__part", value))
    ranked = placed.withColumn("__rank", F.col("__k") * (upto - (ties - 1) / 2.0))  # within the range
    ranges = ranked.groupBy(gene, "__part", group).agg(F.sum("__rank").alias("__sum"), F.sum("__k").alias("__k"), F.sum(F.col("__k") * F.expm1(value)).alias("__lin"))
    # what lies in lower ranges, the zeros too, lifts a range's ranks
    held = ranges.groupBy(gene, "__part").agg(F.sum("__k").alias("__c")).groupBy(gene).agg(F.collect_list(F.struct("__part", "__c")).alias("__held"), F.sum("__c").alias("__nnz"))
    lower = F.aggregate(F.filter("__held", lambda h: h["__part"] < F.col("__part")), F.lit(total) - F.col("__nnz"), lambda n, h: n + h["__c"])
    per = ranges.join(held, gene).groupBy(gene, group).agg(F.sum(F.col("__sum") + F.col("__k") * lower).alias("__sum"), F.sum("__k").alias("__k"), F.sum("__lin").alias("__lin"))
    whole = per.groupBy(gene).agg(F.sum("__k").alias("__kall"), F.sum("__lin").alias("__linall"))
    each = F.array(*(F.struct(F.lit(r[group]).alias("g"), F.lit(r["n_in"]).alias("n")) for r in sizes if r[group] is not None))
    kind = groups.schema[group].dataType.simpleString()
    pairs = whole.withColumn("__g", F.explode(each.cast(f"array<struct<g:{kind},n:bigint>>"))).withColumns({group: F.col("__g.g"), "n_in": F.col("__g.n")}).drop("__g")
    out = pairs.join(per, [gene, group], "left").na.fill(0, ["__sum", "__k", "__lin"])
    zeros = F.lit(total) - F.col("__kall")
    in_zeros = F.col("n_in") - F.col("__k")
    n_out = F.lit(total) - F.col("n_in")
    rank_sum = F.col("__sum") + in_zeros * (zeros + 1) / 2.0
    mean = F.col("n_in") * (F.lit(total) + 1) / 2.0
    sd = F.sqrt(F.col("n_in").cast("double") * n_out * (F.lit(total) + 1) / 12.0)  # as whole numbers the product passes 63 bits
    tiny = 1e-9
    fold = F.log2((F.col("__lin") / F.col("n_in") + tiny) / (F.try_divide(F.col("__linall") - F.col("__lin"), n_out) + tiny))
    return out.select(gene, group, "n_in", n_out.alias("n_out"), rank_sum.alias("rank_sum"), F.try_divide(rank_sum - mean, sd).alias("z"), fold.alias("log_fold_change"), (F.col("__k") / F.col("n_in")).alias("pct_in"), F.try_divide((F.col("__kall") - F.col("__k")).cast("double"), n_out).alias("pct_out"))


def markers(x: DataFrame, groups: DataFrame, least_fold: float = 0.0, most_p: float = 0.05) -> DataFrame:
    """Rank sums with p-values, adjusted a group, of the genes that pass (FLT10)."""
    tested = rank_sums(x, groups).withColumn("p", F.coalesce(two_sided_p(F.col("z")), F.lit(1.0)))
    return benjamini_hochberg(tested, "p", ["grp"], "gene").where((F.col("p_adj") < most_p) & (F.col("log_fold_change") > least_fold))


def similarity(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Pearson correlation, cosine and Euclidean distance of two columns a
    group; correlation and cosine are NaN where either column sums to 0 (STA15)."""
    nan = F.lit(float("nan"))
    out = df.groupBy(by).agg(F.corr(a, b).alias("pearson"), F.sum(F.col(a) * F.col(b)).alias("__ab"), F.sum(F.col(a) ** 2).alias("__aa"), F.sum(F.col(b) ** 2).alias("__bb"), F.sum((F.col(a) - F.col(b)) ** 2).alias("__d"), F.sum(a).alias("__a"), F.sum(b).alias("__b"))
    none = (F.col("__a") == 0) | (F.col("__b") == 0)
    return out.select(by, F.when(none, nan).otherwise(F.coalesce("pearson", nan)).alias("pearson"), F.when(none, nan).otherwise(F.col("__ab") / F.sqrt(F.col("__aa") * F.col("__bb"))).alias("cosine"), F.sqrt("__d").alias("distance"))


def spearman(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation a group, ties at their mean rank (STA15, STA16).

    Only a group's distinct values are put in order, and rows meet the ranks of one column
    alone: their sums by values of the other are all that the other's ranks need.
    Null where a column has one value only."""

    def ranks(c: str) -> DataFrame:
        """__by, __v, __k and __r: the rank of a value less the mean rank of its group."""
        values = df.groupBy(F.col(by).alias("__by"), F.col(c).alias("__v")).agg(F.count("*").alias("__k"))
        w = Window.partitionBy("__by")
        upto = F.sum("__k").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        return values.withColumn("__r", upto - (F.col("__k") - 1) / 2.0 - (F.sum("__k").over(w) + 1) / 2.0)

    same = lambda one, v: F.col(one).eqNullSafe(F.col("__by")) & F.col(v).eqNullSafe(F.col("__v"))
    sums = df.select(by, a, b).join(ranks(b), same(by, b)).groupBy(by, a).agg(F.sum("__r").alias("__s"), F.sum(F.col("__r") * F.col("__r")).alias("__bb"))
    both = sums.join(ranks(a), same(by, a)).groupBy(by).agg(F.sum(F.col("__r") * F.col("__s")).alias("__ab"), F.sum(F.col("__k") * F.col("__r") * F.col("__r")).alias("__aa"), F.sum("__bb").alias("__bb"))
    return both.select(by, F.try_divide("__ab", F.sqrt("__aa") * F.sqrt("__bb")).alias("spearman"))


def percentiles(df: DataFrame, c: str, by: list[str], at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact percentiles of a column a group, linear between neighbours, in
    columns p10, p25 and so on (AGG19)."""
    long = exact_percentiles(df, [c], by, at)
    return long.groupBy(*by).agg(*(F.max(F.when(F.col("at") == p, F.col("value"))).alias(f"p{round(100 * p):02d}") for p in at))


def cumulative_share(df: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """Running share of a group's total in the order of a column (WIN7)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(by)))


def gradient(c: str, w: Window) -> Column:
    """Central differences, one-sided at both ends (WIN8)."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)
