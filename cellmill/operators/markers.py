"""Marker panels: their algebra, scores and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proposed_panel(curated: DataFrame, reference: DataFrame, database: DataFrame) -> DataFrame:
    """compartment, gene and where it comes from: curated, or both the reference
    and the database have it (SET2).  The inputs have compartment and gene."""
    rows = None
    for name, df in (("curated", curated), ("ref", reference), ("db", database)):
        own = df.select("compartment", "gene").withColumn("__s", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    flags = rows.groupBy("compartment", "gene").agg(*(F.bool_or(F.col("__s") == n).alias(f"in_{n}") for n in ("curated", "ref", "db")))
    return flags.where("in_curated OR (in_ref AND in_db)")


def panel_summary(panel: DataFrame) -> DataFrame:
    """Sizes a compartment and the genes as sorted text (AGG16, PIV7)."""
    return panel.groupBy("compartment").agg(
        F.count("*").alias("n_genes"), F.count_if("in_curated").alias("n_curated"), F.count_if(F.col("in_curated") & F.col("in_db")).alias("n_curated_in_db"), F.array_join(F.sort_array(F.collect_set("gene")), ";").alias("genes")
    )


def prune_reasons(panel: DataFrame, shared_least: int = 2, prefixes: tuple[str, ...] = ("HLA-D",), names: tuple[str, ...] = ("CD74",), manual: tuple[str, ...] = ()) -> DataFrame:
    """``panel`` with reason: why a gene is dropped, several joined by |, empty
    where it stays: shared by compartments, antigen presentation, by hand (SET3)."""
    shared = panel.select("gene", "compartment").distinct().groupBy("gene").agg(F.count("*").alias("__n"))
    presented = F.col("gene").isin(*names) if names else F.lit(False)
    for p in prefixes:
        presented = presented | F.col("gene").startswith(p)
    by_hand = F.col("gene").isin(*manual) if manual else F.lit(False)
    why = F.array(F.when(F.col("__n") >= shared_least, "shared"), F.when(presented, "antigen_presentation"), F.when(by_hand, "manual"))
    return panel.join(shared, "gene").withColumn("reason", F.array_join(F.array_compact(why), "|")).drop("__n")


def provenance(panel: DataFrame) -> DataFrame:
    """The first source that has a gene, curated before the others (JOI18)."""
    return panel.withColumn("source", F.when(F.col("in_curated"), "curated").otherwise("ref_and_db"))


def module_scores(x: DataFrame, panel: DataFrame, n_cells: int, n_bins: int = 25, control: int = 50, seed: int = 0) -> DataFrame:
    """cell, compartment, score: the mean of a panel's genes less the mean of
    control genes from the same bins of mean expression (STA14).

    ``x`` holds log-normalised values, zeros left out; ``panel`` compartment
    and gene.  Controls are the ``control`` genes of a bin of the smallest
    seeded hash, other than the panel's; no random stream is needed.
    """
    means = x.groupBy("gene").agg((F.sum("value") / n_cells).alias("mean"))
    bins = equal_bins(means, "mean", "gene", n_bins)
    own = panel.join(bins.select("gene", "bin"), "gene")
    wanted = own.select("compartment", "bin").distinct().join(bins.select("gene", "bin"), "bin").join(panel.select("compartment", "gene").withColumn("__own", F.lit(1)), ["compartment", "gene"], "left").where("__own IS NULL")
    w = Window.partitionBy("compartment", "bin").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("compartment"), F.col("gene").cast("string"))), "gene")
    picked = wanted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= control)
    genes = own.select("compartment", "gene", F.lit(1.0).alias("sign")).unionByName(picked.select("compartment", "gene", F.lit(-1.0).alias("sign")))
    sizes = genes.groupBy("compartment").agg(F.count_if(F.col("sign") > 0).alias("np"), F.count_if(F.col("sign") < 0).alias("nc"))
    weight = F.when(F.col("sign") > 0, 1.0 / F.col("np")).otherwise(-1.0 / F.greatest(F.col("nc"), F.lit(1)))
    weights = genes.join(sizes, "compartment").select("compartment", "gene", weight.alias("weight"))
    return x.join(weights, "gene").groupBy("cell", "compartment").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def equal_bins(df: DataFrame, value: str, key: str, n: int, out: str = "bin") -> DataFrame:
    """Bins of equal size by the value (1 to n).  Quantiles make the bins, so
    that no task sorts all rows; equal values share a bin."""
    edges = df.agg(F.percentile(value, [k / n for k in range(1, n)]).alias("e"))  # one row
    return df.join(F.broadcast(edges)).withColumn(out, F.size(F.filter("e", lambda x: x < F.col(value))) + 1).drop("e")


def detection_fold(x: DataFrame, cells: DataFrame, mask: str, genes: DataFrame) -> DataFrame:
    """gene, rate_in, rate_out, fold: the shares of cells in and out of a mask
    where a gene is found; an infinite fold where it is found inside only
    (AGG17)."""
    n = cells.agg(F.count_if(mask).alias("__in"), F.count_if(~F.col(mask)).alias("__out"))  # one row
    found = x.where("value > 0").join(genes, "gene", "left_semi").join(cells.select("cell", mask), "cell")
    per = genes.join(found.groupBy("gene").agg(F.count_if(mask).alias("__a"), F.count_if(~F.col(mask)).alias("__b")), "gene", "left").na.fill(0, ["__a", "__b"])
    out = per.join(F.broadcast(n)).select("gene", F.coalesce(F.try_divide(F.col("__a").cast("double"), "__in"), F.lit(0.0)).alias("rate_in"), F.coalesce(F.try_divide(F.col("__b").cast("double"), "__out"), F.lit(0.0)).alias("rate_out"))
    return out.withColumn("fold", F.when(F.col("rate_out") > 0, F.col("rate_in") / F.col("rate_out")).when(F.col("rate_in") > 0, F.lit(float("inf"))).otherwise(0.0))


def any_of(x: DataFrame, cells: DataFrame, genes: DataFrame, out: str) -> DataFrame:
    """``cells`` with a flag: whether any of the genes is found there (ARR4)."""
    hit = x.where("value > 0").join(genes, "gene", "left_semi").select("cell").distinct().withColumn(out, F.lit(True))
    return cells.join(hit, "cell", "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def contingency(a: Column, b: Column) -> list[Column]:
    """Aggregates: the four counts of two flags (AGG18)."""
    return [F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_only_a"), F.count_if(~a & b).alias("n_only_b"), F.count_if(~a & ~b).alias("n_neither")]


def best_labels(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, label, score: the compartment of the highest score, of equal ones
    the first by name; scores count as equal up to nine decimals, as sums differ
    by their order (ARR2)."""
    best = scores.groupBy("cell").agg(F.min_by(F.struct("compartment", "score"), F.struct(F.negative(F.round("score", 9)), "compartment")).alias("b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.col("b.compartment").alias("label"), F.col("b.score").alias("score"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """From which label to which, and how many cells (STA24, PIV1)."""
    both = before.select("cell", F.col("label").alias("from_label")).join(after.select("cell", F.col("label").alias("to_label")), "cell")
    return both.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
