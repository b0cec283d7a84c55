"""Joins with their guards, set algebra, duplicates, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order`` (DED1, WIN4)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_n(df: DataFrame, key: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first n rows a key with their rank (WIN5, TOP2)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= n)


def unique_names(df: DataFrame, name: str, order: list[Column], out: str = "unique_name") -> DataFrame:
    """Names made unique: the k-th repeat gets the suffix -k (DED3)."""
    w = Window.partitionBy(name).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), (n - 1).cast("string"))))


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n_left, n_matched and match_pct of the distinct keys (JOI1)."""
    l, r = left.select(key).distinct(), right.select(key).distinct().withColumn("__m", F.lit(1))
    return l.join(r, key, "left").agg(F.count("*").alias("n_left"), F.count("__m").alias("n_matched")).withColumn("match_pct", F.round(100.0 * F.try_divide("n_matched", "n_left"), 6))


def joined_or(left: DataFrame, right: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for what the right side lacks (JOI3)."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def last_of_duplicates(df: DataFrame, key: list[str], seq: Column) -> DataFrame:
    """One row a key, the last by ``seq``: as a dictionary keeps it (JOI5, JOI6)."""
    return keep_first(df, key, [seq.desc()])


def complete_or_raise(labelled: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The inner join, refused if a labelled key has no counts (JOI10).  Runs
    the check at once."""
    missing = labelled.join(counts, key, "left_anti").select(key).distinct().count()
    if missing:
        raise ValueError(f"{missing} labelled rows have no counts")
    return labelled.join(counts, key)


def existence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """A row a key with a flag a source (JOI17)."""
    rows = None
    for name, df in sources.items():
        own = df.select(F.col(key)).distinct().withColumn("__s", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(*(F.bool_or(F.col("__s") == name).alias(f"in_{name}") for name in sources))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection, union and differences of two name sets (SET1)."""
    both = existence({"a": a, "b": b}, key)
    return both.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"),
        F.count("*").alias("n_either"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_only_a"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("n_only_b"),
    )


def value_counts(df: DataFrame, *cols: str, within: list[str] | None = None, pct: str = "pct") -> DataFrame:
    """Counts with their percentage of all rows, or of those ``within`` (AGG8, WIN11)."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    if within:
        share = F.col("n") / F.sum("n").over(Window.partitionBy(*within))
        return counts.withColumn(pct, F.round(100.0 * share, 6))
    total = counts.agg(F.sum("n").alias("__t"))  # one row
    return counts.join(F.broadcast(total)).withColumn(pct, F.round(100.0 * F.col("n") / F.col("__t"), 6)).drop("__t")


def crosstab(df: DataFrame, row: str, col: str, values: list, value: Column | None = None) -> DataFrame:
    """A row a value of ``row`` and a column for each of ``values``, zeros
    filled: counts, or sums of ``value`` (PIV1, PIV3).  The fixed list of
    columns spares Spark a pass that looks for them."""
    what = F.count(F.lit(1)) if value is None else F.sum(value)
    return df.groupBy(row).pivot(col, values).agg(what).na.fill(0)


def row_shares(table: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as shares of their row's total; 0 where that is 0 (PIV2)."""
    total = sum((F.col(c) for c in cols), F.lit(0))
    return table.withColumns({c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), total), F.lit(0.0)), 6) for c in cols})


def natural_order(c: Column) -> list[Column]:
    """Sort keys: numbers by value, then texts (SRT3)."""
    return [F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).asc_nulls_last(), c.asc()]


def marked_first(c: Column, mark: str, seq: Column) -> list[Column]:
    """Sort keys: names that hold the mark first, each part in its old order (SRT4)."""
    return [(~F.lower(c).contains(mark)).cast("int"), seq]


def stratified(df: DataFrame, strata: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows a stratum without replacement, by a seeded hash of the key: the
    same rows whatever the partitions (SMP1)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return keep_ranked(df, strata, [h, F.col(key)], n)


def keep_ranked(df: DataFrame, strata: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(strata).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def positional_slice(df: DataFrame, order: list[Column], n: int = 200) -> DataFrame:
    """The first n rows in a stated order (SMP2)."""
    return df.orderBy(*order).limit(n)


def mapped(df: DataFrame, col: str, vocabulary: DataFrame, out: str, default: str | None = "unresolved") -> DataFrame:
    """``col`` through vocabulary (src, dst); without a match the default, or
    the value itself where the default is None (MAP1, MAP2)."""
    m = vocabulary.select(F.col("src").alias(col), F.col("dst").alias(out)).dropDuplicates([col])
    return df.join(m, col, "left").withColumn(out, F.coalesce(F.col(out), F.col(col) if default is None else F.lit(default)))


def vocabulary(spark, pairs: dict[str, str]) -> DataFrame:
    """A literal dictionary as a table (D13)."""
    return spark.createDataFrame(sorted(pairs.items()), "src string, dst string")
