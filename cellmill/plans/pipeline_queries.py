"""The domain's pipelines from end to end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from . import pipelines
from . import tables as t
from .file_queries import NATION_COUNTS, expression_file, written_lines
from .registry import CELLS, X, query, r6


@query(f"""WITH {NATION_COUNTS}, b AS (SELECT n_name AS cell, n_nationkey + 0.0 AS x, n_regionkey + 0.0 AS y FROM nation WHERE n_regionkey <> 2)
    SELECT nx.cell || '_P' AS cell, 'P' AS puck, any_value(x) AS x, any_value(y) AS y, count(*) AS n_genes, sum(value) AS total_counts
    FROM nx JOIN b ON nx.cell = b.cell WHERE value <> 0 GROUP BY nx.cell""")
def pip_load_puck(spark: SparkSession, sf: str) -> DataFrame:
    n = t.table(spark, sf, "nation").where("n_regionkey <> 2")
    twice = n.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.0))))
    lines = twice.select(F.concat_ws("\t", F.concat(F.lit("o"), "n_nationkey"), "n_name", F.col("n_nationkey") + F.col("shift"), F.col("n_regionkey") + F.col("shift")).alias("value"))
    _, obs = pipelines.load_puck(spark, expression_file(spark, sf), written_lines(lines, "puck"), "P")
    return obs.select("cell", "puck", "x", "y", "n_genes", "total_counts")


NAMED = f"""{X}, {CELLS}, nx AS (
    SELECT puck, x.cell, CASE WHEN p_size <= 5 THEN 'MT-' WHEN p_size > 45 THEN 'RPS' ELSE 'G' END || x.gene AS gene, value
    FROM x JOIN cells ON x.cell = cells.cell JOIN part ON p_partkey = x.gene)"""


def named_counts(spark: SparkSession, sf: str) -> DataFrame:
    """puck, cell, gene (with the prefixes of the domain), value"""
    p = t.table(spark, sf, "part")
    prefix = F.when(F.col("p_size") <= 5, "MT-").when(F.col("p_size") > 45, "RPS").otherwise("G")
    x = t.matrix(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell").join(p.select(F.col("p_partkey").alias("gene"), prefix.alias("n")), "gene")
    return x.select("puck", "cell", F.concat("n", "gene").alias("gene"), "value")


@query(f"""WITH {NAMED},
    r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS k FROM nx WHERE value <> 0),
    m AS (SELECT puck, cell, ln(1 + sum(value)) AS a, ln(1 + count(*)) AS b, 100.0 * sum(value) FILTER (k <= 20) / sum(value) AS t, 100.0 * coalesce(sum(value) FILTER (gene LIKE 'MT-%'), 0) / sum(value) AS p FROM r GROUP BY puck, cell),
    med AS (SELECT puck, median(a) AS ma, median(b) AS mb, median(t) AS mt, median(p) AS mp FROM m GROUP BY puck),
    mad AS (SELECT m.puck, median(abs(a - ma)) AS da, median(abs(b - mb)) AS db, median(abs(t - mt)) AS dt, median(abs(p - mp)) AS dp FROM m JOIN med ON m.puck = med.puck GROUP BY m.puck),
    f AS (SELECT m.puck, m.cell, abs(a - ma) > 5 * da OR abs(b - mb) > 5 * db OR abs(t - mt) > 5 * dt AS outlier, abs(p - mp) > 3 * dp OR p > 25 AS mt_outlier FROM m JOIN med ON m.puck = med.puck JOIN mad ON m.puck = mad.puck),
    good AS (SELECT nx.* FROM nx JOIN f ON nx.cell = f.cell WHERE NOT outlier AND NOT mt_outlier),
    s2 AS (SELECT * FROM good WHERE cell IN (SELECT cell FROM good GROUP BY cell HAVING count(*) FILTER (value > 0) >= 2)),
    s3 AS (SELECT s2.* FROM s2 JOIN (SELECT puck, gene FROM s2 GROUP BY 1, 2 HAVING count(*) FILTER (value > 0) >= 2) g ON s2.puck = g.puck AND s2.gene = g.gene),
    s4 AS (SELECT * FROM s3 WHERE gene IN (SELECT gene FROM s3 GROUP BY gene HAVING count(DISTINCT puck) = (SELECT count(DISTINCT puck) FROM s3)))
    SELECT puck, count(DISTINCT cell) AS n_cells, count(DISTINCT gene) AS n_genes, sum(value) AS total FROM s4 GROUP BY puck""")
def pip_qc_and_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged, _ = pipelines.qc_and_merge(named_counts(spark, sf), min_genes=2, min_cells=2)
    return merged.groupBy("puck").agg(F.count_distinct("cell").alias("n_cells"), F.count_distinct("gene").alias("n_genes"), F.sum("value").alias("total"))


@query("""WITH v AS (
        SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unresolved' END AS a, CASE l_linestatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unresolved' END AS b
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT a AS a_coarse, b AS b_coarse, count(*) AS n FROM v GROUP BY 1, 2""")
def pip_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    obs = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderstatus", "l_linestatus")
    _, pairs = pipelines.annotators_reconciled(obs, "o_orderstatus", "l_linestatus", relational.vocabulary(spark, {"F": "closed", "O": "open"}))
    return pairs.select("a_coarse", "b_coarse", "n")


@query("""WITH e AS (SELECT 'r' || (event_id % 500) AS q, 'c' || (user_id % 100) AS cb, 'u' || (event_id % 7) AS ub, CASE length(event_type) % 3 WHEN 0 THEN '77' WHEN 1 THEN '88' ELSE '0' END AS taxid, event_id FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY event_id) AS k FROM e),
    b AS (SELECT r.cb, r.ub, c.taxid FROM k r JOIN k c ON r.q = c.q AND r.k = c.k WHERE c.taxid <> '0'),
    n AS (SELECT cb, ub, taxid, count(*) AS n FROM b GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY cb, ub ORDER BY n DESC, taxid) AS r FROM n)
    SELECT cb AS cell, taxid AS gene, CAST(count(*) AS DOUBLE) AS value FROM w WHERE r = 1 GROUP BY 1, 2""")
def pip_virus_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "events")
    name = F.concat(F.lit("r"), F.col("event_id") % 500).alias("query_name")
    kind = F.length("event_type") % 3
    reads = e.select(name, F.concat(F.lit("c"), F.col("user_id") % 100, F.lit("-1")).alias("cb"), F.concat(F.lit("u"), F.col("event_id") % 7).alias("ub"), F.col("event_id").alias("seq"))
    calls = e.select(name, F.when(kind == 0, "a virus (taxid 77)").when(kind == 1, "88").otherwise("0").alias("call"), F.col("event_id").alias("seq"))
    return pipelines.virus_matrix(reads, calls)


@query("""WITH g AS (SELECT l_returnflag AS chrom, l_partkey AS start, CASE l_linenumber % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'G' ELSE 'A' END AS base, l_linenumber AS reads, CAST(l_quantity AS INTEGER) AS depth FROM lineitem),
    c AS (SELECT 'N' AS chrom, p_partkey AS start, substr('ACGT', p_size % 4 + 1, 1) AS up, substr('CGTA', p_size % 4 + 1, 1) AS down FROM part WHERE p_size < 40),
    k AS (SELECT coalesce(up, 'N') AS up, coalesce(down, 'N') AS down, base FROM g LEFT JOIN c ON g.chrom = c.chrom AND g.start = c.start WHERE base IN ('T', 'G') AND reads >= 3 AND depth >= 5)
    SELECT up || 'C' || down AS ref_tri, up || base || down AS alt_tri, count(*) AS n FROM k GROUP BY 1, 2""")
def pip_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), F.lit("C").alias("ref"), F.lit("T,G").alias("alt_expected"), F.col("l_suppkey").alias("cb"),
        F.when(kind == 0, "T").when(kind == 1, "G").otherwise("A").alias("base_observed"), F.col("l_linenumber").alias("num_reads"), F.col("l_quantity").cast("int").alias("total_depth"),
    )
    size = (F.col("p_size") % 4 + 1).cast("int")
    near, far = (F.substring(F.lit(x), size, F.lit(1)) for x in ("ACGT", "CGTA"))
    contexts = t.table(spark, sf, "part").where("p_size < 40").select(F.lit("N").alias("chrom"), F.col("p_partkey").alias("start"), F.concat(near, F.lit("X")).alias("up_context"), F.concat(F.lit("X"), far).alias("down_context"), F.col("p_partkey").alias("seq"))
    kept, _ = pipelines.genotypes(rows, contexts)
    return kept.groupBy("ref_tri", "alt_tri").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_suppkey AS cb, arg_max(CAST(l_quantity AS INTEGER), l_orderkey * 10 + l_linenumber) AS sites FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT s_suppkey AS cb, coalesce(sites, 0) AS sites FROM supplier LEFT JOIN f ON cb = s_suppkey""")
def pip_callable_sites(spark: SparkSession, sf: str) -> DataFrame:
    files = t.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("cb"), F.col("l_quantity").cast("int").alias("sites"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    sites, _ = pipelines.callable_sites(t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cb")), files)
    return sites


@query("""WITH s AS (
        SELECT l_suppkey AS cell, substr('ACGT', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS ref, substr('ACGT', CAST(l_linenumber % 4 + 1 AS INTEGER), 1) AS alt,
               substr('ACGTN', CAST(l_orderkey % 5 + 1 AS INTEGER), 1) AS up, substr('TGCA', CAST(l_partkey % 3 + 1 AS INTEGER), 1) AS down FROM lineitem),
    m AS (SELECT cell, CASE WHEN ref IN ('C', 'T') THEN up || '[' || ref || '>' || alt || ']' || down
                            ELSE translate(down, 'ACGT', 'TGCA') || '[' || translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') || ']' || translate(up, 'ACGT', 'TGCA') END AS context
          FROM s WHERE ref <> alt AND up <> 'N'),
    c AS (SELECT cell, context, count(*) AS n FROM m GROUP BY 1, 2),
    names AS (SELECT a || '[' || s || ']' || b AS context FROM (VALUES ('C>A'), ('C>G'), ('C>T'), ('T>A'), ('T>C'), ('T>G')) x(s), (VALUES ('A'), ('C'), ('G'), ('T')) y(a), (VALUES ('A'), ('C'), ('G'), ('T')) z(b))
    SELECT k.cell, names.context, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT cell FROM c) k CROSS JOIN names LEFT JOIN c ON c.cell = k.cell AND c.context = names.context""")
def pip_context_matrix(spark: SparkSession, sf: str) -> DataFrame:
    letter = lambda letters, k: F.substring(F.lit(letters), (k + 1).cast("int"), F.lit(1))
    ref = letter("ACGT", F.col("l_partkey") % 4)
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cb"), ref.alias("ref"), letter("ACGT", F.col("l_linenumber") % 4).alias("alt_expected"),
        F.concat(letter("ACGTN", F.col("l_orderkey") % 5), ref, letter("TGCA", F.col("l_partkey") % 3)).alias("ref_tri"),
    )
    return pipelines.context_matrix(rows).select("cell", "context", "n")


@query(f"WITH {X} SELECT gene, count(*) AS n, sum(value) AS total FROM x JOIN part ON p_partkey = gene WHERE p_size < 10 GROUP BY gene")
def pip_reference_built(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf)
    labels = x.select("cell").distinct().withColumn("label", F.lit("k"))
    built = pipelines.reference_built(x, labels, t.table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("gene")))
    return built.groupBy("gene").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {X}, g AS (SELECT count(DISTINCT gene) AS n FROM x WHERE value <> 0), c AS (SELECT count(DISTINCT cell) AS n FROM x)
    SELECT g.n AS n_before, g.n AS n_after, 0.0 AS max_diff, c.n AS n_cells, 0 AS n_duplicates, true AS is_raw FROM g, c""")
def pip_merge_health(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell")
    h = pipelines.merge_health(x, x, x.select("gene").distinct())
    one = h["conservation"].join(h["cells"]).join(h["raw"])  # a row each
    return one.select("n_before", "n_after", r6("max_diff").alias("max_diff"), F.col("n_keys").alias("n_cells"), F.col("n_duplicates").cast("int").alias("n_duplicates"), "is_raw")


@query("""WITH m AS (SELECT l_suppkey AS cell, count(*) AS mutations FROM lineitem GROUP BY 1), s AS (SELECT s_suppkey AS cell, CAST(s_nationkey AS INTEGER) AS sites FROM supplier)
    SELECT m.cell, CASE WHEN coalesce(sites, 0) > 0 THEN mutations ELSE 0 END AS mutations, round(CASE WHEN sites > 0 THEN CAST(mutations AS DOUBLE) / sites ELSE 0 END, 6) AS burden FROM m LEFT JOIN s ON m.cell = s.cell""")
def pip_burden_masked(spark: SparkSession, sf: str) -> DataFrame:
    m = t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count("*").alias("mutations"))
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").cast("int").alias("sites"))
    return pipelines.burden_masked(m, s).withColumn("burden", r6("burden"))


@query(f"""WITH {X}, {CELLS}, vi AS (SELECT x.* FROM x JOIN part ON p_partkey = gene WHERE gene % 5 = 0 AND p_size > 10), ho AS (SELECT * FROM x WHERE gene % 5 <> 0),
    cm AS (SELECT cell FROM vi INTERSECT SELECT cell FROM ho), bo AS (SELECT * FROM vi WHERE cell IN (FROM cm) UNION ALL SELECT * FROM ho WHERE cell IN (FROM cm)),
    v AS (SELECT cell, gene, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell)) AS v FROM bo),
    grp AS (SELECT cell, puck AS grp FROM cells WHERE cell IN (FROM cm)), sz AS (SELECT grp, count(*) AS n_in FROM grp GROUP BY 1), nn AS (SELECT count(*) AS n FROM grp),
    rk AS (SELECT v.gene, v.cell, rank() OVER (PARTITION BY v.gene ORDER BY v.v) + (count(*) OVER (PARTITION BY v.gene, v.v) - 1) / 2.0 + n - count(*) OVER (PARTITION BY v.gene) AS r FROM v, nn),
    pr AS (SELECT gene, grp, sum(r) AS s, count(*) AS k FROM rk JOIN grp USING (cell) GROUP BY 1, 2), al AS (SELECT gene, sum(k) AS kall FROM pr GROUP BY 1),
    z AS (SELECT al.gene, (coalesce(s, 0) + (n_in - coalesce(k, 0)) * (n - kall + 1) / 2.0 - n_in * (n + 1) / 2.0) / sqrt(n_in * (n - n_in) * (n + 1) / 12.0) AS z FROM al CROSS JOIN sz LEFT JOIN pr ON pr.gene = al.gene AND pr.grp = sz.grp, nn)
    SELECT gene, round(sum(z), 6) AS score FROM z WHERE z > 0.0001 AND gene % 5 = 0 GROUP BY 1 ORDER BY sum(z) DESC, gene LIMIT 10""")
def pip_viruses_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth part stands for a taxon, the others for the host's genes."""
    x = t.matrix(spark, sf)
    wanted = t.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene"))
    groups = t.cells(spark, sf).select("cell", F.col("puck").alias("grp"))
    found = pipelines.viruses_ranked(x.where("gene % 5 <> 0"), x.where("gene % 5 = 0"), wanted, groups)
    return found.withColumn("score", r6("score"))
