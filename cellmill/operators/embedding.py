"""Normalisation and selection of genes before an embedding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .qc import exact_percentiles

#: A local regression is fitted at so many evenly spaced percentiles of x, and at
#: as many evenly spaced values, for where x is sparse.
VERTICES = 17
#: Distinct cell totals that a task holds at a time.
DEPTHS = 1 << 16


def residual_variance(x: DataFrame, theta: float = 100.0) -> DataFrame:
    """gene, mean and variance of the clipped Pearson residuals over all cells,
    zeros included (STA3).

    A zero's residual depends on the gene's total and the cell's alone, so
    cells of one total are counted together; genes meet those counts in blocks
    of a bounded size, one pass a block.
    """
    spark = x.sparkSession
    depth = x.groupBy("cell").agg(F.sum("value").alias("d"))
    totals = depth.agg(F.sum("d").alias("t"), F.count("*").alias("n")).first()
    t, n = float(totals["t"] or 0), totals["n"]
    if not n or not t:
        return spark.createDataFrame([], "gene string, residual_mean double, residual_variance double")
    clip = float(np.sqrt(n))
    genes = x.groupBy("gene").agg(F.sum("value").alias("g"))
    kind = dict(genes.dtypes)["gene"]
    mu = F.col("d") * F.col("g") / F.lit(t)
    z = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - mu) / F.sqrt(mu + mu * mu / F.lit(theta))))
    scored = x.join(depth, "cell").join(genes, "gene").withColumn("z", z(F.col("value"))).withColumn("z0", z(F.lit(0.0)))
    more = scored.groupBy("gene").agg(F.sum(F.col("z") - F.col("z0")).alias("s"), F.sum(F.col("z") ** 2 - F.col("z0") ** 2).alias("ss"))
    histogram = depth.groupBy("d").agg(F.count("*").alias("m"))
    blocks = max(1, -(-histogram.count() // DEPTHS))
    base = None
    for k in range(blocks):
        part = histogram.where(F.pmod(F.xxhash64("d"), F.lit(blocks)) == k).toArrow()  # DEPTHS rows, about
        shared = spark.sparkContext.broadcast((part["d"].to_numpy().astype(float), part["m"].to_numpy().astype(float)))

        def zeros(batches, shared=shared):
            d, m = shared.value
            for batch in batches:
                g = batch.column("g").to_numpy().astype(float)
                s, ss = np.zeros(len(g)), np.zeros(len(g))
                for at in range(0, len(g), max(1, (1 << 20) // max(1, len(d)))):
                    some = slice(at, at + max(1, (1 << 20) // max(1, len(d))))
                    mean = g[some, None] * d[None, :] / t
                    v = np.maximum(-clip, -mean / np.sqrt(mean + mean**2 / theta))
                    s[some], ss[some] = v @ m, (v**2) @ m
                yield pa.record_batch([batch.column("gene"), pa.array(s), pa.array(ss)], names=["gene", "s", "ss"])

        own = genes.mapInArrow(zeros, f"gene {kind}, s double, ss double")
        base = own if base is None else base.unionByName(own)
    sums = base.unionByName(more).groupBy("gene").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / n
    return sums.select("gene", mean.alias("residual_mean"), (F.col("ss") / n - mean * mean).alias("residual_variance"))


def variable_genes(x: DataFrame, top: int = 2000, theta: float = 100.0) -> DataFrame:
    """The ``top`` genes of the highest residual variance, with their rank (STA3)."""
    return residual_variance(x, theta).orderBy(F.desc("residual_variance"), "gene").limit(top)


def residuals(x: DataFrame, genes: DataFrame, theta: float = 100.0) -> DataFrame:
    """cell, gene, value: residuals of stored values over totals of the chosen
    genes alone, and base: what a zero there would have (STA4)."""
    some = x.join(genes.select("gene"), "gene", "left_semi")
    total = some.agg(F.sum("value").alias("t"), F.count_distinct("cell").alias("n"))  # one row
    by_cell = some.groupBy("cell").agg(F.sum("value").alias("d"))
    by_gene = some.groupBy("gene").agg(F.sum("value").alias("g"))
    mu = F.col("d") * F.col("g") / F.col("t")
    clip = F.sqrt("n")
    z = lambda v: F.greatest(-clip, F.least(clip, (v - mu) / F.sqrt(mu + mu * mu / F.lit(theta))))
    return some.join(by_cell, "cell").join(by_gene, "gene").join(F.broadcast(total)).select("cell", "gene", z(F.col("value")).alias("value"), z(F.lit(0.0)).alias("base"))


def moments(x: DataFrame, n_cells: int) -> DataFrame:
    """gene, mean and sample variance over all cells, zeros included."""
    s = x.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    mean = F.col("s") / n_cells
    return s.select("gene", mean.alias("mean"), ((F.col("ss") - n_cells * mean * mean) / max(1, n_cells - 1)).alias("variance"))


def dispersion_genes(x: DataFrame, n_cells: int, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, n_bins: int = 20) -> DataFrame:
    """gene, mean, dispersion, normalised dispersion and whether it is variable:
    log dispersion as a z-score within bins of the log mean; a bin of one gene
    gets 1 (STA5).  ``x`` is log-normalised."""
    linear = x.withColumn("value", F.expm1("value"))
    m = moments(linear, n_cells).where("mean > 0").withColumns({"dispersion": F.log(F.greatest(F.col("variance") / F.col("mean"), F.lit(1e-12))), "mean": F.log1p("mean")})
    edges = m.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))  # one row
    binned = m.join(F.broadcast(edges)).withColumn("bin", F.least(F.lit(n_bins - 1), F.floor(F.coalesce(F.try_divide((F.col("mean") - F.col("lo")) * n_bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int"))
    per = binned.groupBy("bin").agg(F.avg("dispersion").alias("bm"), F.stddev("dispersion").alias("bs"))
    scored = binned.join(F.broadcast(per), "bin").withColumn("dispersion_norm", F.when(F.col("bs").isNull() | (F.col("bs") == 0), F.lit(1.0)).otherwise((F.col("dispersion") - F.col("bm")) / F.col("bs")))
    good = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("dispersion_norm") > min_disp)
    return scored.select("gene", "mean", "dispersion", "dispersion_norm", good.alias("variable"))


def local_regression(df: DataFrame, x: str, y: str, span: float = 0.3, out: str = "fit") -> DataFrame:
    """``df`` with a local quadratic fit of y on x (STA5); null where x or y is
    null or not finite.

    The fit is made at VERTICES percentiles and even steps of x, each over the nearest ``span``
    of the rows with tricube weights; between two of them a cubic takes their
    values and slopes.  Rows meet a vertex in one grouped sum of ten moments, so
    only a row a vertex reaches the driver.
    """
    good = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))  # noqa: E731  # NaN is larger than all
    points = stored(df.where(good(x) & good(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    n = points.count()
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    at = tuple(k / (VERTICES - 1) for k in range(VERTICES))
    knots = {r["value"] for r in exact_percentiles(points, ["x"], [], at).select("value").collect()}
    low, high = min(knots), max(knots)
    knots = sorted(knots | {low + (high - low) * p for p in at[1:-1]})
    near = points.withColumn("knot", F.explode(F.array(*map(F.lit, knots)))).withColumn("d", F.abs(F.col("x") - F.col("knot")))
    q = min(n, max(3, math.ceil(span * n)))
    radius = exact_percentiles(near, ["d"], ["knot"], ((q - 1) / max(1, n - 1),)).select("knot", F.col("value").alias("h"))
    radius = {r["knot"]: r["h"] for r in radius.collect()}
    h = F.element_at(F.create_map(*(F.lit(c) for v in knots for c in (v, radius[v] or 1e-300))), F.col("knot"))
    t = F.col("x") - F.col("knot")
    inside = near.withColumns({"t": t, "w": F.pow(1 - F.pow(F.col("d") / h, 3.0), 3.0)}).where(F.col("d") < h)
    t = F.col("t")
    sums = inside.groupBy("knot").agg(
        *(F.sum(F.col("w") * F.pow(t, float(k))).alias(f"s{k}") for k in range(5)), *(F.sum(F.col("w") * F.pow(t, float(k)) * F.col("y")).alias(f"y{k}") for k in range(3))
    )
    fits = {}
    for r in sums.collect():  # two rows a vertex at most
        a = np.array([[r[f"s{i + j}"] for j in range(3)] for i in range(3)])
        scale = (radius[r["knot"]] or 1.0) ** np.arange(3)
        fits[r["knot"]] = np.linalg.lstsq(a / np.outer(scale, scale), np.array([r[f"y{k}"] for k in range(3)]) / scale, rcond=1e-12)[0] / scale
    f, g = (F.array(*(F.lit(float(fits[v][k])) for v in knots)) for k in range(2))
    if len(knots) == 1:
        return df.withColumn(out, F.when(good(x) & good(y), f[0]))
    k = F.array(*map(F.lit, knots))
    i = F.greatest(F.lit(1), F.least(F.lit(len(knots) - 1), F.size(F.filter(k, lambda e: e <= F.col(x)))))
    wide = F.element_at(k, i + 1) - F.element_at(k, i)
    u = (F.col(x) - F.element_at(k, i)) / wide
    cubic = F.element_at(f, i) * (1 + 2 * u) * (1 - u) ** 2 + F.element_at(g, i) * wide * u * (1 - u) ** 2 + F.element_at(f, i + 1) * u * u * (3 - 2 * u) + F.element_at(g, i + 1) * wide * u * u * (u - 1)
    return df.withColumn(out, F.when(good(x) & good(y), cubic))


def fitted_variance(x: DataFrame, n_cells: int, span: float = 0.3) -> DataFrame:
    """gene, mean, variance, variance_norm: the variance of counts as z-scores by
    the deviation that genes of such a mean have, values clipped at the root of
    the number of cells (STA5).  Genes that don't vary get 0."""
    m = stored(moments(x, n_cells).withColumns({"lm": F.when(F.col("mean") > 0, F.log10("mean")), "lv": F.when(F.col("variance") > 0, F.log10("variance"))}), "moments")
    fit = local_regression(m, "lm", "lv", span).withColumn("sd", F.sqrt(F.pow(F.lit(10.0), F.coalesce("fit", F.lit(0.0)))))
    most = F.col("mean") + F.lit(math.sqrt(n_cells)) * F.col("sd")
    sums = x.join(fit.select("gene", "mean", "sd"), "gene").withColumn("c", F.least(F.col("value").cast("double"), most)).groupBy("gene").agg(F.sum("c").alias("s"), F.sum(F.col("c") ** 2).alias("ss"))
    norm = (n_cells * F.col("mean") ** 2 + F.col("ss") - 2 * F.col("mean") * F.col("s")) / (max(1, n_cells - 1) * F.col("sd") ** 2)
    return fit.join(sums, "gene").select("gene", "mean", "variance", F.when(F.col("lv").isNull(), 0.0).otherwise(norm).alias("variance_norm"))


def fitted_variable_genes(x: DataFrame, n_cells: int, top: int = 2000, span: float = 0.3) -> DataFrame:
    """The ``top`` genes of the highest normalised variance; ties by name (STA5)."""
    return fitted_variance(x, n_cells, span).orderBy(F.desc("variance_norm"), "gene").limit(top)


def scaled(x: DataFrame, n_cells: int, most: float = 10.0) -> DataFrame:
    """Stored values as z-scores of their gene, ``most`` at most, and base: the
    z-score of a zero (STA6)."""
    m = moments(x, n_cells)
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    return x.join(m, "gene").select("cell", "gene", F.least(F.lit(most), (F.col("value") - F.col("mean")) / sd).alias("value"), F.least(F.lit(most), -F.col("mean") / sd).alias("base"))


def regressed(df: DataFrame, y: str, on: str, by: str) -> DataFrame:
    """Residuals of a least-squares line a group (STA6)."""
    fit = df.groupBy(by).agg(F.regr_slope(y, on).alias("__b"), F.regr_intercept(y, on).alias("__a"))
    return df.join(fit, by).withColumn("residual", F.col(y) - F.coalesce(F.col("__a") + F.col("__b") * F.col(on), F.col(y))).drop("__a", "__b")


def column_z(df: DataFrame, value: str, by: str, out: str = "z") -> DataFrame:
    """z-scores within a group, population deviation and 1e-9 (WIN10)."""
    w = Window.partitionBy(by)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-9))


def components(vectors: DataFrame, vector: str, k: int) -> DataFrame:
    """``vectors`` with pcs: scores of the first k principal components (STA7).
    The sign of a component is free; it is set so that its largest loading is
    positive."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import DenseMatrix
    from pyspark.ml.feature import PCA

    some = vectors.where(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(some)
    load: DenseMatrix = model.pc
    m = load.toArray()
    m = m * np.sign(m[np.abs(m).argmax(axis=0), np.arange(m.shape[1])])
    dims = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, m[:, j].tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(k)]
    return some.drop("__v").withColumn("pcs", F.array(*dims))
