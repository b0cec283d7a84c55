"""Variants, intervals, contexts and molecule counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_list
from .relational import last_of_duplicates

# The six substitutions of a pyrimidine and the four bases.
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
BASES = ("A", "C", "G", "T")


def contexts96() -> list[str]:
    """The 96 classes, by substitution, then 5' base, then 3' base (STR18)."""
    return [f"{a}[{s}]{b}" for s in SUBSTITUTIONS for a in BASES for b in BASES]


def evidence_reason(base: Column, alt: Column, reads: Column, depth: Column, least_reads: int = 3, least_depth: int = 5) -> Column:
    """Why a genotype row is refused, first failing rule first; null if it isn't (FLT5)."""
    return F.when(~in_list(base, alt), "base").when(~F.coalesce(reads >= least_reads, F.lit(False)), "reads").when(~F.coalesce(depth >= least_depth, F.lit(False)), "depth")


def funnel(df: DataFrame, reason: str) -> DataFrame:
    """Rows kept and rows lost to each reason, in one pass (FLT5)."""
    return df.agg(F.count("*").alias("n_total"), F.count_if(F.col(reason).isNull()).alias("n_kept"), *(F.count_if(F.coalesce(F.col(reason) == k, F.lit(False))).alias(f"n_{k}") for k in ("base", "reads", "depth")))


def substitutions(df: DataFrame, ref: str, alt: str, context: str) -> DataFrame:
    """Single-base substitutions with no N around them (FLT6)."""
    return df.where((F.length(ref) == 1) & (F.length(alt) == 1) & (F.col(ref) != F.col(alt)) & ~F.col(context).contains("N"))


def context_of(df: DataFrame, contexts: DataFrame, key: list[str], seq: Column, base: str, out: str) -> DataFrame:
    """The base around a site; of repeated sites the last counts, of unknown
    ones N (JOI5)."""
    one = last_of_duplicates(contexts, key, seq).select(*key, F.col(base).alias(out))
    return df.join(one, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("N")))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """One row a pair of overlapping half-open intervals, with a's columns, its
    start and end clipped to the overlap, and b's others (JOI13).

    Both sides go to the bins that they touch, so the join is on equal keys; a
    pair is kept in the bin where its overlap begins, so it comes once.  Empty
    intervals overlap nothing.
    """
    bins = lambda df: df.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(F.expr(f"{start} div {bin_size}"), F.expr(f"({end} - 1) div {bin_size}"))))
    left = bins(a)
    right = bins(b).withColumnsRenamed({start: "__s", end: "__e"})
    both = left.join(right, [chrom, "__bin"]).where((F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end)))
    low = F.greatest(F.col(start), F.col("__s"))
    once = both.where(F.col("__bin") == F.floor(low / bin_size))
    return once.withColumns({start: low, end: F.least(F.col(end), F.col("__e"))}).drop("__bin", "__s", "__e")


def molecule_votes(reads: DataFrame, cell: str, umi: str, taxon: str) -> DataFrame:
    """cell, taxon, n_umis: each molecule goes to its commonest taxon, of equal
    ones to the smallest as text; molecules are counted (AGG6).  Reads without
    cell, molecule or taxon take no part."""
    some = reads.where(F.col(cell).isNotNull() & F.col(umi).isNotNull() & F.col(taxon).isNotNull())
    counts = some.groupBy(cell, umi, taxon).agg(F.count("*").alias("__n"))
    best = counts.groupBy(cell, umi).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(taxon).cast("string").alias("t"))).alias("__b"))
    return best.groupBy(F.col(cell), F.col("__b.t").alias(taxon)).agg(F.count("*").alias("n_umis"))


def named_reads(reads: DataFrame, calls: DataFrame, name: str = "query_name") -> DataFrame:
    """Reads beside their calls by name; of repeated names the k-th read meets
    the k-th call (JOI14, SRC16)."""
    from pyspark.sql import Window

    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(name).orderBy("seq")
        return df.withColumn("__k", F.row_number().over(w)).drop("seq")

    return numbered(reads).join(numbered(calls), [name, "__k"]).drop("__k")


def flag_set(flag: Column, bit: int = 4) -> Column:
    """Whether a bit of a read's flag is set (FLT13)."""
    return flag.bitwiseAND(F.lit(bit)) != 0


def burden(mutations: Column, callable_sites: Column) -> Column:
    """Mutations a callable site, 0 where there is none (STA26)."""
    return F.coalesce(F.try_divide(mutations.cast("double"), callable_sites), F.lit(0.0))
