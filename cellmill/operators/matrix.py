"""Sparse matrices as long tables (cell, gene, value), zeros left out.

What zeros would add to a sum, a mean, a rank or a variance is added in closed
form; no matrix is ever made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL, GENE, VALUE = "cell", "gene", "value"


def cell_metrics(x: DataFrame, flags: DataFrame | None = None, flag_cols: tuple[str, ...] = (), top: int = 20) -> DataFrame:
    """A row a cell: n_genes, total_counts, their log1p, the share of the
    ``top`` largest values, and total and share of each flagged gene set (AGG1,
    TOP1).

    ``flags`` has a row a gene with boolean columns; it is joined, so Spark
    broadcasts it only if it is small.
    """
    some = x.where(F.col(VALUE) != 0)
    if flags is not None:
        some = some.join(flags.select(GENE, *flag_cols), GENE, "left")
    w = Window.partitionBy(CELL).orderBy(F.desc(VALUE), GENE)
    ranked = some.withColumn("__r", F.row_number().over(w))
    total = F.sum(VALUE)
    out = ranked.groupBy(CELL).agg(
        F.count("*").alias("n_genes"),
        total.alias("total_counts"),
        F.sum(F.when(F.col("__r") <= top, F.col(VALUE))).alias("__top"),
        *(F.sum(F.when(F.col(f), F.col(VALUE)).otherwise(0)).alias(f"total_counts_{f}") for f in flag_cols),
    )
    pct = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total_counts")), F.lit(0.0))
    return out.withColumns(
        {"log1p_n_genes": F.log1p("n_genes"), "log1p_total_counts": F.log1p("total_counts"), f"pct_top_{top}": pct("__top")} | {f"pct_counts_{f}": pct(f"total_counts_{f}") for f in flag_cols}
    ).drop("__top")


def gene_metrics(x: DataFrame, n_cells: int | Column) -> DataFrame:
    """A row a gene: n_cells, total_counts, mean_counts, pct_dropout (AGG1)."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    return x.where(F.col(VALUE) != 0).groupBy(GENE).agg(F.count("*").alias("n_cells"), F.sum(VALUE).alias("total_counts")).withColumns({"mean_counts": F.col("total_counts") / n, "pct_dropout": 100.0 * (1 - F.col("n_cells") / n)})


def cells_with(x: DataFrame, min_genes: int = 0, min_counts: float = 0) -> DataFrame:
    """The rows of cells with enough genes and counts (FLT2, FLT4)."""
    good = x.groupBy(CELL).agg(F.count_if(F.col(VALUE) > 0).alias("__g"), F.sum(VALUE).alias("__c")).where((F.col("__g") >= min_genes) & (F.col("__c") >= min_counts))
    return x.join(good.select(CELL), CELL, "left_semi")


def genes_with(x: DataFrame, min_cells: int) -> DataFrame:
    """The rows of genes in enough cells (FLT3)."""
    good = x.groupBy(GENE).agg(F.count_if(F.col(VALUE) > 0).alias("__c")).where(F.col("__c") >= min_cells)
    return x.join(good.select(GENE), GENE, "left_semi")


def permissive_genes(x: DataFrame, n_cells: int, cell_count: int = 5, cell_share: float = 0.03, nonzero_mean: float = 1.12) -> DataFrame:
    """Genes in more than ``cell_share`` of the cells, or in more than
    ``cell_count`` with a mean over ``nonzero_mean`` where present (FLT14)."""
    g = x.where(F.col(VALUE) > 0).groupBy(GENE).agg(F.count("*").alias("n"), F.avg(VALUE).alias("m"))
    return g.where((F.col("n") > cell_share * n_cells) | ((F.col("n") > cell_count) & (F.col("m") > nonzero_mean))).select(GENE)


def log_normalised(x: DataFrame, target: float = 1e4, keep: tuple[str, ...] = ()) -> DataFrame:
    """log1p of values scaled to one total a cell (STA1)."""
    w = Window.partitionBy(CELL)
    return x.select(CELL, GENE, *keep, F.log1p(F.col(VALUE) * F.lit(target) / F.sum(VALUE).over(w)).alias(VALUE))


def back_to_linear(x: DataFrame) -> DataFrame:
    """expm1 of log-normalised values (STA2)."""
    return x.withColumn(VALUE, F.expm1(VALUE))


def inner_genes(x: DataFrame, batch: str = "puck") -> DataFrame:
    """The rows of genes that every batch has (UNI1).  A gene is had where it
    has a row, a zero too."""
    batches = x.select(batch).distinct().count()
    everywhere = x.groupBy(GENE).agg(F.count_distinct(batch).alias("__b")).where(F.col("__b") == batches)
    return x.join(everywhere.select(GENE), GENE, "left_semi")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Gene-wise union over the cells that both have; names prefixed by their
    side (JOI9)."""
    common = left.select(CELL).intersect(right.select(CELL))
    both = left.select(CELL, GENE, VALUE).withColumn("side", F.lit("left")).unionByName(right.select(CELL, GENE, VALUE).withColumn("side", F.lit("right")))
    return both.join(common, CELL, "left_semi")


def aligned(x: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the wanted genes, and the wanted genes that have none (JOI11)."""
    wanted = genes.select(GENE).distinct()
    return x.join(wanted, GENE, "left_semi"), wanted.join(x.select(GENE).distinct(), GENE, "left_anti")


def shared_or_raise(a: DataFrame, b: DataFrame, least: int = 200) -> DataFrame:
    """Genes that both have; refused if there are fewer than ``least`` (JOI12).
    Runs the check at once."""
    genes = a.select(GENE).intersect(b.select(GENE))
    n = genes.count()
    if n < least:
        raise ValueError(f"{n} shared genes, fewer than {least}")
    return genes


def zero_filled(counts: DataFrame, rows: DataFrame, cols: list[str], row: str, col: str, value: str) -> DataFrame:
    """Every row with every one of a fixed list of columns, zeros where there is
    no count (PIV4).  The list is part of the plan: no join of all with all."""
    full = rows.select(row).distinct().withColumn(col, F.explode(F.array(*map(F.lit, cols))))
    return full.join(counts, [row, col], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def dense_ids(df: DataFrame, col: str, out: str, ranges: int = 200) -> DataFrame:
    """Numbers from 1 for the sorted distinct values (AGG7).

    Values fall into ranges between some of them, chosen by hash; each range is
    numbered by itself, after the sizes of those before it.  The driver holds
    the ``ranges`` edges and sizes; numbers don't depend on partitions.
    """
    names = df.where(F.col(col).isNotNull()).select(col).distinct()
    edges = sorted(r[0] for r in names.orderBy(F.md5(F.col(col).cast("string")), col).limit(ranges).collect())
    if not edges:
        return names.select(col, F.lit(1).cast("long").alias(out))
    placed = names.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(col))))
    sizes = {r["__b"]: r["n"] for r in placed.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for b in sorted(sizes):
        starts += [F.lit(b), F.lit(before)]
        before += sizes[b]
    n = F.row_number().over(Window.partitionBy("__b").orderBy(col))
    return placed.select(col, (F.create_map(*starts)[F.col("__b")] + n).cast("long").alias(out))
