"""Quality control: robust outliers and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .matrix import cells_with, genes_with


#: Groups of more rows are bracketed by a sketch first; the share of a group's
#: rows on either side of a percentile that the bracket takes in, and the sketch's
#: accuracy, whose error is a quarter of that share.
BRACKETED, SLACK, ACCURACY = 5000, 2e-3, 2_000


def exact_percentiles(df: DataFrame, cols: list[str], by: list[str], at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """by, name, at, n, nans, value: exact percentiles of columns a group, linear
    between neighbours; nulls take no part, and a NaN makes all of a group's null.

    No group meets in one buffer.  Groups of ``BRACKETED`` rows or fewer count their
    equal values and order them once for all percentiles.  Of larger ones a sketch
    brackets each percentile;
    what lies below the bracket is only counted, equal values inside it are
    counted once, and only those are put in order: some thousandths of a large
    group's rows.  The counts show whether the wanted ranks lie inside; a bracket
    that misses one is opened to the whole group.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols))
    rows = df.select(*by, F.explode(pairs).alias("__x")).select(*by, "__x.name", "__x.v").where("v IS NOT NULL")
    key = [*by, "name"]
    # a row a group and column: its size is known, so joins broadcast it where it is small
    sizes = stored(rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("nans")), "sizes")
    large, small = sizes.where(F.col("n") > BRACKETED), sizes.where(F.col("n") <= BRACKETED)
    kinds = sizes.agg(F.count_if(F.col("n") > BRACKETED).alias("large"), F.count_if(F.col("n") <= BRACKETED).alias("small")).first()
    of = lambda some, whole: rows if whole else rows.join(some.select(*key), key, "left_semi")
    ends = None
    if kinds["large"]:
        ends = _bracketed(of(large, not kinds["small"]), large, key, at)
    if kinds["small"] or ends is None:
        own = _ordered(of(small, not kinds["large"]), key, at)
        ends = own if ends is None else ends.unionByName(own)
    full = sizes.select(*key, "n", "nans", F.explode(F.array(*map(F.lit, at))).alias("at"))
    out = full.join(ends, [*key, "at"], "left")
    return out.withColumn("value", F.when(F.col("nans") == 0, F.col("value")))


def _ordered(rows: DataFrame, key: list[str], at: tuple[float, ...]) -> DataFrame:
    """key, at, value of groups whose values can be put in order by one task."""
    values = rows.groupBy(*key, "v").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy(*key))})
    end = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    rank = {p: F.lit(p) * (F.col("n") - 1) for p in at}
    found = placed.groupBy(*key).agg(F.max("n").alias("n"), F.array(*(F.struct(end(F.floor(rank[p])).alias("a"), end(F.ceil(rank[p])).alias("b"), F.lit(p).alias("at")) for p in at)).alias("e"))
    each = found.select(*key, "n", F.explode("e").alias("e")).select(*key, "n", "e.*")
    r = F.col("at") * (F.col("n") - 1)
    return each.select(*key, "at", (F.col("a") + (F.col("b") - F.col("a")) * (r - F.floor(r))).alias("value"))


def _bracketed(rows: DataFrame, sizes: DataFrame, key: list[str], at: tuple[float, ...]) -> DataFrame:
    """key, at, value of groups of any size, whose ``sizes`` are given, if none is NaN."""
    edges = [min(max(p + side * SLACK, 0.0), 1.0) for p in at for side in (-1, 1)]
    sketch = stored(rows.groupBy(*key).agg(F.percentile_approx("v", edges, ACCURACY).alias("e")).join(sizes, key), "sketch")
    wanted = F.array(*(F.struct(F.lit(p).alias("at"), F.col("e")[2 * k].alias("low"), F.col("e")[2 * k + 1].alias("high")) for k, p in enumerate(at)))
    ends = stored(_inside(rows, sketch.where("nans = 0").select(*key, "n", F.explode(wanted).alias("w")), key), "percentiles")
    missed = ends.where("NOT sure")
    if missed.limit(1).count():
        whole = F.struct("at", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
        ends = ends.where("sure").unionByName(_inside(rows, missed.select(*key, "n", whole.alias("w")), key))
    return ends.select(*key, "at", "value")


def _inside(rows: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """key, at, n, value, and whether the brackets w (at, low, high) that were
    ``asked`` for hold the ranks that make the value."""
    beside = rows.join(asked, key).where("v <= w.high")
    values = beside.groupBy(*key, "w.at", "n", F.when(F.col("v") >= F.col("w.low"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    upto = values.withColumn("k", F.sum("k").over(Window.partitionBy(*key, "at").orderBy(F.asc_nulls_first("v"))))
    rank = F.col("at") * (F.col("n") - 1)
    end = lambda r: F.min(F.when(F.col("v").isNotNull() & (F.col("k") > r), F.col("v")))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0))
    found = upto.groupBy(*key, "at", "n").agg(end(F.floor(rank)).alias("a"), end(F.ceil(rank)).alias("b"), below.alias("below"), F.max("k").alias("upto"))
    sure = (F.col("below") <= F.floor(rank)) & (F.col("upto") > F.ceil(rank))
    return found.select(*key, "at", "n", (F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias("value"), sure.alias("sure"))


def medians(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Exact medians a group, a column each (AGG2)."""
    long = exact_percentiles(df, cols, by)
    return long.groupBy(*by).agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in cols))


def mad_bounds(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Median and unscaled median absolute deviation of columns a group, as
    <col>_med and <col>_mad; both null where the column holds a NaN, which then
    marks nothing (AGG3)."""
    med = medians(df, cols, by).withColumnsRenamed({c: f"{c}_med" for c in cols})
    off = medians(df.join(med, by).select(*by, *(F.abs(F.col(c) - F.col(f"{c}_med")).alias(c) for c in cols)), cols, by)
    return med.join(off.withColumnsRenamed({c: f"{c}_mad" for c in cols}), by)


def outlier(col: str, nmads: float) -> Column:
    """Whether a value lies strictly outside median -+ nmads * MAD (AGG3)."""
    far = F.lit(nmads) * F.col(f"{col}_mad")
    return F.coalesce((F.col(col) < F.col(f"{col}_med") - far) | (F.col(col) > F.col(f"{col}_med") + far), F.lit(False))


def flagged(cells: DataFrame, by: list[str], count_cols: list[str], mt_col: str, nmads: float = 5, mt_nmads: float = 3, mt_most: float = 25) -> DataFrame:
    """``cells`` with outlier (any of the count columns) and mt_outlier (beyond
    its MADs or over a hard limit) (AGG4).  The metrics are stored first, as
    medians, deviations and flags each read them."""
    cells = stored(cells, "metrics")
    bounds = stored(mad_bounds(cells, [*count_cols, mt_col], by), "bounds")
    out = cells.join(bounds, by)
    any_ = F.lit(False)
    for c in count_cols:
        any_ = any_ | outlier(c, nmads)
    out = out.withColumn("outlier", any_).withColumn("mt_outlier", outlier(mt_col, mt_nmads) | (F.col(mt_col) > mt_most))
    return out.drop(*(f"{c}_{k}" for c in [*count_cols, mt_col] for k in ("med", "mad")))


def filtered(x: DataFrame, flags: DataFrame, min_genes: int, min_cells: int) -> DataFrame:
    """Cells that aren't flagged, then cells with enough genes, then genes in
    enough cells: three steps, in this order (FLT1 to FLT3)."""
    good = flags.where(~F.col("outlier") & ~F.col("mt_outlier")).select("cell")
    return genes_with(cells_with(x.join(good, "cell", "left_semi"), min_genes), min_cells)


def with_totals(df: DataFrame, by: str, medians_of: dict[str, str] | None = None, **aggs: Column) -> DataFrame:
    """A row a group and one for all, named ``all`` (AGG5); ``medians_of`` names
    exact medians by their columns."""
    out = df.rollup(by).agg(F.grouping(by).alias("__g"), *(c.alias(n) for n, c in aggs.items()))
    out = out.withColumn(by, F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col(by))).drop("__g")
    if not medians_of:
        return out
    cols = sorted(set(medians_of.values()))
    both = df.select(by, *cols).withColumn(by, F.explode(F.array(F.col(by), F.lit("all"))))
    middle = medians(both, cols, [by]).select(by, *(F.col(c).alias(n) for n, c in medians_of.items()))
    return out.join(middle, by, "left")
