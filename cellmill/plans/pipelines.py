"""The domain's pipelines, composed of operators.  All are lazy, but for the
guards that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import consensus, embedding, health, markers, matrix, qc, relational, signatures, spatial, stats, variants
from ..sources import tables
from ..sources.scratch import stored


def load_puck(spark: SparkSession, expression: str, barcodes: str, puck: str) -> tuple[DataFrame, DataFrame]:
    """(x, obs) of one puck: counts of the barcodes that have a place, the first
    place of a barcode counts; metrics beside the places.  Refuses a puck where
    none matches (PIP1)."""
    places = relational.keep_first(tables.barcode_matching(spark, barcodes), ["corrected_barcode"], [F.col("seq")])
    places = places.select(F.col("corrected_barcode").alias("cell"), "x", "y")
    x = tables.digital_expression(spark, expression).join(places.select("cell"), "cell", "left_semi")
    if x.isEmpty():
        raise ValueError(f"no barcode of {expression} is in {barcodes}")
    key = text.composite(F.col("cell"), F.lit(puck))
    obs = places.join(matrix.cell_metrics(x), "cell").withColumns({"cell": key, "puck": F.lit(puck)})
    return x.withColumns({"cell": key, "puck": F.lit(puck)}), obs


def gene_flags(x: DataFrame) -> DataFrame:
    """gene with mt, ribo and hb by the beginnings of the names (STR1, STR2)."""
    g = F.col("gene")
    return x.select("gene").distinct().withColumns({"mt": text.has_prefix(g, "MT-", "mt-", "Mt-"), "ribo": text.has_prefix(g, "RPS", "RPL"), "hb": text.haemoglobin(g)})


def qc_and_merge(x: DataFrame, min_genes: int = 100, min_cells: int = 10, nmads: float = 5) -> tuple[DataFrame, DataFrame]:
    """(merged, flags): pucks filtered each by its own bounds, then merged over
    the genes that all of them keep (PIP2).  ``x`` has puck, cell, gene, value."""
    x = stored(x, "counts")  # five steps read it
    where = x.select("cell", "puck").distinct()
    m = matrix.cell_metrics(x, gene_flags(x), ("mt",)).join(where, "cell")
    flags = qc.flagged(m, ["puck"], ["log1p_total_counts", "log1p_n_genes", "pct_top_20"], "pct_counts_mt", nmads)
    good = stored(x.join(flags.where("NOT outlier AND NOT mt_outlier").select("cell"), "cell", "left_semi"), "good-cells")
    cells = good.groupBy("cell").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_genes)
    kept = good.join(cells.select("cell"), "cell", "left_semi")
    genes = kept.groupBy("puck", "gene").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells)
    return matrix.inner_genes(kept.join(genes.select("puck", "gene"), ["puck", "gene"], "left_semi")), flags


def annotators_reconciled(obs: DataFrame, a: str, b: str, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(obs with agreement and label, counts of the pairs of coarse labels) (PIP3)."""
    out = consensus.reconciled(obs, a, b, vocabulary)
    return out, relational.value_counts(out, "a_coarse", "b_coarse")


def panel_built(x: DataFrame, groups: DataFrame, curated: DataFrame, database: DataFrame, crosswalk: DataFrame, species: str = "Hs", n: int = 50) -> DataFrame:
    """The proposed panel: curated genes, and those that are both among the n best
    significant markers of a compartment and in the database (PIP4).

    ``groups``: cell and grp; ``database``: species, gene, cell_type; the
    ``crosswalk`` (src, dst) names the compartment of either's labels.
    """
    in_database = database.where(F.coalesce(F.col("species").contains(species), F.lit(False))).join(crosswalk.select(F.col("src").alias("cell_type"), F.col("dst").alias("compartment")), "cell_type")
    coarse = groups.join(crosswalk.select(F.col("src").alias("grp"), F.col("dst").alias("compartment")), "grp").select("cell", F.col("compartment").alias("grp"))
    found = stats.markers(matrix.log_normalised(x), coarse)
    best = relational.top_n(found, ["grp"], [F.desc("z"), F.asc("gene")], n).withColumnRenamed("grp", "compartment")
    panel = markers.proposed_panel(curated, best, in_database)
    return panel.join(x.select("gene").distinct(), "gene", "left_semi")


def marker_bakeoff(x: DataFrame, panel: DataFrame, obs: DataFrame, n_cells: int, manual: tuple[str, ...] = ()) -> DataFrame:
    """cell, cluster, marker, margin, cluster_marker, confidence and unified: pruned
    panels score each cell, the best score is its marker label, clusters vote by
    margins, and an ambiguous consensus label takes the cell's or else the
    cluster's marker where it is among the choices (PIP5).

    ``obs``: cell, cluster, consensus.
    """
    kept = markers.prune_reasons(panel, manual=manual).where("reason = ''")
    norm = stored(matrix.log_normalised(x), "normalised")  # means and scores read it
    scores = markers.module_scores(norm, kept.select("compartment", "gene"), n_cells)
    w = F.struct(F.round("score", 9).alias("s"), F.col("compartment").alias("c"))  # not by the order of a sum
    two = scores.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(w), asc=False), 1, 2).alias("b"))  # a row a compartment
    best = two.select("cell", F.col("b")[0]["c"].alias("marker"), F.col("b")[0]["s"].alias("top"), (F.col("b")[0]["s"] - F.coalesce(F.try_element_at("b", F.lit(2))["s"], F.lit(0.0))).alias("margin"))
    own = obs.join(best, "cell", "left").withColumn("marker", consensus.gated(F.col("marker"), F.col("top"), F.col("margin")))
    vote = consensus.margin_vote(own.where("marker <> 'ambiguous'"), "cluster", "marker", "margin").select("cluster", F.col("label").alias("cluster_marker"), "confidence")
    out = own.join(vote, "cluster", "left")
    first = consensus.adjudicated(F.col("consensus"), F.col("marker"))
    return out.withColumn("unified", F.when(first != "unresolved", first).otherwise(consensus.adjudicated(F.col("consensus"), F.col("cluster_marker"))))


def mask_diagnostic(x: DataFrame, cells: DataFrame, mask: str, panel: DataFrame, n_cells: int, left_out: str) -> dict[str, DataFrame]:
    """detection: rates in and out of a mask; flips: labels that change without
    one gene; enrichment: the mask among neighbours (PIP6).  ``cells``: batch,
    cell, x, y and the mask."""
    edges = spatial.plane_neighbours(cells, 15, batch="batch")
    return {
        "detection": markers.detection_fold(x, cells, mask, panel.select("gene").distinct()),
        "flips": label_flips(matrix.log_normalised(x), cells, panel, n_cells, left_out),
        "enrichment": spatial.enrichment(edges, cells, mask),
    }


def label_flips(norm: DataFrame, cells: DataFrame, panel: DataFrame, n_cells: int, left_out: str | int) -> DataFrame:
    """How many cells go from which best label to which without one gene of the panel (PIP6)."""
    genes, norm = panel.select("compartment", "gene"), stored(norm, "normalised")
    before, after = (markers.best_labels(markers.module_scores(norm, some, n_cells), cells) for some in (genes, genes.where(F.col("gene") != left_out)))
    return markers.flips(before, after)


def virus_matrix(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """cell, gene (a taxon), value: molecules of reads and their taxon calls
    (PIP7).  ``reads``: query_name, cb, ub, seq; ``calls``: query_name, call, seq."""
    both = variants.named_reads(reads, calls.withColumn("taxid", text.taxid(F.col("call"))).drop("call"))
    bare = both.withColumn("cb", text.before(F.col("cb"))).where("taxid <> '' AND taxid <> '0'")
    return variants.molecule_votes(bare, "cb", "ub", "taxid").select(F.col("cb").alias("cell"), F.col("taxid").alias("gene"), F.col("n_umis").cast("double").alias("value"))


def viruses_ranked(host: DataFrame, viral: DataFrame, wanted: DataFrame, groups: DataFrame, n: int = 10) -> DataFrame:
    """gene and score: viral taxa by the sum of their rank-sum scores over groups,
    on counts of both sides normalised together (PIP8).  Names that are host genes
    too are left out, by equality."""
    some = viral.join(wanted.select("gene"), "gene", "left_semi")
    both = matrix.side_by_side(host, some)
    norm = matrix.log_normalised(both)
    tested = stats.rank_sums(norm, groups.join(norm.select("cell").distinct(), "cell", "left_semi")).where("z > 0.0001")
    only = tested.join(some.select("gene").distinct(), "gene", "left_semi").join(host.select("gene").distinct(), "gene", "left_anti")
    return only.groupBy("gene").agg(F.sum("z").alias("score")).orderBy(F.desc("score"), "gene").limit(n)


def genotypes(rows: DataFrame, contexts: DataFrame, least_reads: int = 3, least_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept rows with the bases around, funnel) (PIP9).  ``rows``: chrom, start,
    ref, alt_expected, cb, base_observed, num_reads, total_depth; ``contexts``:
    chrom, start, up_context, down_context, seq."""
    judged = rows.withColumn("reason", variants.evidence_reason(F.col("base_observed"), F.col("alt_expected"), F.col("num_reads"), F.col("total_depth"), least_reads, least_depth))
    kept = judged.where("reason IS NULL").drop("reason")
    sides = contexts.withColumns({"u": text.second_letter(F.reverse("up_context")), "d": text.second_letter(F.col("down_context"))})
    for c, out in (("u", "up"), ("d", "down")):
        kept = variants.context_of(kept, sides, ["chrom", "start"], F.col("seq"), c, out)
    tri = F.concat("up", "ref", "down")
    return kept.withColumns({"ref_tri": tri, "alt_tri": F.concat("up", "base_observed", "down")}), variants.funnel(judged, "reason")


def callable_sites(cells: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with sites, counters): the last file that names a cell counts, 0
    where none does (PIP10).  ``files``: cb, sites, seq."""
    last = relational.last_of_duplicates(files, ["cb"], F.col("seq")).select("cb", "sites")
    out = relational.joined_or(cells, last, ["cb"], {"sites": 0})
    return out, health.counters(out, covered=F.col("sites") > 0, empty=F.col("sites") == 0)


def context_matrix(rows: DataFrame) -> DataFrame:
    """cell, context, n of the 96 classes, zeros too (PIP11).  ``rows``: cb, ref,
    alt_expected, ref_tri."""
    some = variants.substitutions(rows, "ref", "alt_expected", "ref_tri")
    classed = some.select(F.col("cb").alias("cell"), text.mutation_context(F.col("ref"), F.col("alt_expected"), F.col("ref_tri")).alias("context")).where("context IS NOT NULL")
    counts = classed.groupBy("cell", "context").agg(F.count("*").alias("n"))
    return matrix.zero_filled(counts, counts, variants.contexts96(), "cell", "context", "n")


def signature_refit(counts: DataFrame, database: DataFrame, names: list[str], threshold: int = 0, core: list[str] | None = None) -> dict[str, DataFrame]:
    """weights, per_cell, errors, summary, spectrum (PIP12).  With ``core``, the
    scree of the other names decides which of them are fitted."""
    some, _ = signatures.chosen(signatures.scaled(database), names)
    if threshold:
        enough = counts.groupBy("cell").agg(F.sum("n").alias("t")).where(F.col("t") >= threshold)
        counts = counts.join(enough.select("cell"), "cell", "left_semi")
    if core is not None:
        picked, _ = signatures.scree(counts, some, core, [n for n in names if n not in core])
        some = some.where(F.col("signature").isin(picked))
    weights = signatures.exposures(counts, some)
    both = signatures.reconstruction(counts, some, weights)
    per_cell = stats.similarity(both, "cell", "n", "fitted").withColumn("quality", signatures.quality("pearson"))
    contexts = sorted(r["context"] for r in some.select("context").distinct().collect())
    return {"weights": weights, "per_cell": per_cell, "errors": signatures.errors(both), "summary": signatures.summary(weights), "spectrum": signatures.spectrum(counts, contexts)}


def reference_built(counts: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """Labelled counts over the wanted genes; refused unless every labelled cell
    has counts and they are whole numbers (PIP13)."""
    labelled = relational.complete_or_raise(labels, counts, "cell")
    if not health.integer_share(counts, "value").first()["is_raw"]:
        raise ValueError("the counts aren't whole numbers")
    return matrix.aligned(labelled, genes)[0]


def merge_health(parts: DataFrame, merged: DataFrame, panel: DataFrame) -> dict[str, DataFrame]:
    """Conservation a gene, duplicates, whole numbers and the share of panel genes
    that are there (PIP14)."""
    return {
        "conservation": health.conservation(parts, merged, "gene"),
        "cells": health.duplicates(merged.select("puck", "cell").distinct(), "cell"),
        "raw": health.integer_share(merged, "value"),
        "genes": relational.set_sizes(panel.select("gene"), merged.select("gene"), "gene"),
    }


def depth_dependence(vectors: DataFrame, depth: str, x: str, y: str, by: str) -> DataFrame:
    """The larger of the absolute rank correlations of depth with two axes (STA16)."""
    one = stats.spearman(vectors, by, depth, x).withColumnRenamed("spearman", "__x")
    other = stats.spearman(vectors, by, depth, y).withColumnRenamed("spearman", "__y")
    return one.join(other, by).select(by, F.greatest(F.abs("__x"), F.abs("__y")).alias("dependence"))


def normalisations_compared(x: DataFrame, n_cells: int, top: int = 2000, max_mean: float = 3.0) -> dict[str, DataFrame]:
    """The genes that each way of choosing takes, and their overlap (PIP15)."""
    by_residuals = embedding.variable_genes(x, top).select("gene")
    by_dispersion = embedding.dispersion_genes(matrix.log_normalised(x), n_cells, max_mean=max_mean).where("variable").orderBy(F.desc("dispersion_norm"), "gene").limit(top).select("gene")
    return {"residuals": by_residuals, "dispersion": by_dispersion, "overlap": relational.set_sizes(by_residuals, by_dispersion, "gene")}


def whitelist(matching: DataFrame, suffix: str = "-1") -> tuple[DataFrame, DataFrame]:
    """(sorted distinct barcodes without suffix, coordinates) (PIP16)."""
    bare = matching.withColumn("barcode", text.without_suffix(F.col("corrected_barcode"), suffix))
    return bare.select("barcode").distinct().orderBy("barcode"), bare.select("barcode", "x", "y").distinct()


def passed(status: Column) -> Column:
    """(FLT7)"""
    return F.coalesce(status == "PASS", F.lit(False))


def whitelisted(df: DataFrame, names: list[str], prefixes: tuple[str, ...]) -> DataFrame:
    """Columns by name or beginning (FLT15)."""
    return df.select([c for c in df.columns if c in names or c.startswith(prefixes)])


def burden_masked(mutations: DataFrame, sites: DataFrame) -> DataFrame:
    """cell, mutations, burden: cells without callable sites count none (JOI8,
    STA26)."""
    both = mutations.join(sites.select("cell", "sites"), "cell", "left")
    n = F.when(F.coalesce("sites", F.lit(0)) > 0, F.col("mutations")).otherwise(0)
    return both.select("cell", n.alias("mutations"), numeric.ratio(n, F.col("sites")).alias("burden"))
