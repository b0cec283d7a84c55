"""Pipelines that score and choose genes, over the driver's tables: marker
panels, their bake-off and flips, refits, and ways to choose variable genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, signatures
from . import pipelines
from . import tables as t
from .domain_queries import MODULE_PANELS, NORM, PEARSON, module_panel, n_cells, norm
from .registry import COUNTS, P_SQL, X, best_sql, query, r6, scores_sql


@query(f"""WITH {NORM}, {MODULE_PANELS}, {scores_sql('a', 'mp')}, {best_sql('a')}, {scores_sql('b', 'mp2')}, {best_sql('b')}
    SELECT a_best.label AS from_label, b_best.label AS to_label, count(*) AS n FROM orders LEFT JOIN a_best ON a_best.cell = o_orderkey LEFT JOIN b_best ON b_best.cell = o_orderkey GROUP BY 1, 2""")
def pip_mask_flips(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.label_flips(norm(spark, sf), t.cells(spark, sf), module_panel(spark, sf), n_cells(spark, sf), 25)


BAKEOFF = f"""{X}, nx AS (SELECT cell, CASE WHEN p_size <= 5 THEN 'HLA-D' ELSE 'G' END || x.gene AS gene, value FROM x JOIN part ON p_partkey = x.gene),
    norm AS (SELECT cell, gene, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell)) AS v FROM nx), nc AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM x),
    named AS (SELECT p_partkey AS k, CASE WHEN p_size <= 5 THEN 'HLA-D' ELSE 'G' END || p_partkey AS gene FROM part),
    pb AS (SELECT 'c' || CAST((k // 10) % 3 AS VARCHAR) AS compartment, gene FROM named WHERE k % 10 = 0 UNION ALL SELECT 'c' || CAST((k // 10 + 1) % 3 AS VARCHAR), gene FROM named WHERE k % 50 = 0),
    kept AS (SELECT * FROM pb WHERE gene NOT LIKE 'HLA-D%' AND gene <> 'G10' AND gene IN (SELECT gene FROM pb GROUP BY 1 HAVING count(DISTINCT compartment) = 1)),
    {scores_sql('m', 'kept')},
    two AS (SELECT cell, compartment, round(score, 9) AS s, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, compartment DESC) AS r FROM m_ms),
    b AS (SELECT cell, max(compartment) FILTER (r = 1) AS c, max(s) FILTER (r = 1) AS top, max(s) FILTER (r = 1) - coalesce(max(s) FILTER (r = 2), 0) AS margin FROM two GROUP BY 1),
    obs AS (SELECT o_orderkey AS cell, CAST(o_custkey % 40 AS VARCHAR) AS cluster, CASE o_orderkey % 4 WHEN 0 THEN 'c0' WHEN 1 THEN 'ambiguous:c0|c1' WHEN 2 THEN 'ambiguous:c1|c2' ELSE 'c2' END AS consensus FROM orders),
    own AS (SELECT obs.*, CASE WHEN top > 0 AND margin > 0 THEN c ELSE 'ambiguous' END AS marker, margin FROM obs LEFT JOIN b USING (cell)),
    vs AS (SELECT cluster, marker AS label, sum(greatest(margin, 0)) AS s FROM own WHERE marker <> 'ambiguous' GROUP BY 1, 2),
    vote AS (SELECT cluster, label AS cluster_marker, s / sum(s) OVER (PARTITION BY cluster) AS confidence, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, label) AS r FROM vs),
    al AS (SELECT own.*, cluster_marker, confidence, string_split(substr(consensus, 11), '|') AS ch, starts_with(consensus, 'ambiguous:') AS o FROM own LEFT JOIN vote ON vote.cluster = own.cluster AND r = 1)"""


@query(f"""WITH {BAKEOFF} SELECT cell, cluster, marker, round(margin, 6) AS margin, cluster_marker, round(confidence, 6) AS confidence,
    CASE WHEN NOT o THEN consensus WHEN list_contains(ch, marker) THEN marker WHEN coalesce(list_contains(ch, cluster_marker), false) THEN cluster_marker ELSE 'unresolved' END AS unified FROM al""")
def pip_marker_bakeoff(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_size") <= 5, "HLA-D").otherwise("G"), "p_partkey").alias("name"))
    ten = F.floor(F.col("k") / 10)
    of = lambda c: F.concat(F.lit("c"), (c % 3).cast("string")).alias("compartment")
    panel = p.where("k % 10 = 0").select(of(ten), F.col("name").alias("gene")).unionByName(p.where("k % 50 = 0").select(of(ten + 1), F.col("name").alias("gene")))
    x = t.matrix(spark, sf).join(p, F.col("gene") == F.col("k")).select("cell", F.col("name").alias("gene"), "value")
    k = F.col("o_orderkey") % 4
    consensus = F.when(k == 0, "c0").when(k == 1, "ambiguous:c0|c1").when(k == 2, "ambiguous:c1|c2").otherwise("c2")
    obs = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 40).cast("string").alias("cluster"), consensus.alias("consensus"))
    out = pipelines.marker_bakeoff(x, panel, obs, n_cells(spark, sf), manual=("G10",))
    return out.select("cell", "cluster", "marker", r6("margin").alias("margin"), "cluster_marker", r6("confidence").alias("confidence"), "unified")


@query(f"""WITH x AS (SELECT l_orderkey AS cell, l_partkey % 50 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), li AS (SELECT p_partkey % 50 AS k, sum(p_size) AS s FROM part GROUP BY 1),
    norm AS (SELECT cell, gene, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell)) AS v FROM x), cw AS (FROM (VALUES ('F', 'closed'), ('O', 'open'), ('P', 'pending')) v(src, dst)),
    grp AS (SELECT cell, dst AS grp FROM (SELECT cell, ['F', 'O', 'P'][gene % 3 + 1] AS src, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS r FROM x) JOIN cw USING (src) WHERE r = 1),
    sz AS (SELECT grp, count(*) AS n_in FROM grp GROUP BY 1), nn AS (SELECT count(*) AS n FROM grp),
    rk AS (SELECT v.gene, v.cell, v.v, rank() OVER (PARTITION BY v.gene ORDER BY v.v) + (count(*) OVER (PARTITION BY v.gene, v.v) - 1) / 2.0 + n - count(*) OVER (PARTITION BY v.gene) AS r FROM norm v, nn WHERE v.v > 0),
    pr AS (SELECT gene, grp, sum(r) AS s, count(*) AS k, sum(exp(v) - 1) AS lin FROM rk JOIN grp USING (cell) GROUP BY 1, 2), al AS (SELECT gene, sum(k) AS kall, sum(lin) AS linall FROM pr GROUP BY 1),
    te AS (SELECT al.gene, sz.grp, (coalesce(s, 0) + (n_in - coalesce(k, 0)) * (n - kall + 1) / 2.0 - n_in * (n + 1) / 2.0) / sqrt(n_in * (n - n_in) * (n + 1) / 12.0) AS z,
           log2((coalesce(lin, 0) / n_in + 1e-9) / ((linall - coalesce(lin, 0)) / (n - n_in) + 1e-9)) AS fold FROM al CROSS JOIN sz LEFT JOIN pr ON pr.gene = al.gene AND pr.grp = sz.grp, nn),
    ax AS (SELECT *, abs(z) / sqrt(2.0) AS u FROM te),
    tp AS (SELECT *, {P_SQL} AS p FROM ax),
    ra AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene) AS r, count(*) OVER (PARTITION BY grp) AS m FROM tp),
    ad AS (SELECT *, min(p * m / r) OVER (PARTITION BY grp ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS p_adj FROM ra),
    re AS (SELECT grp AS compartment, gene FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, gene) AS k FROM ad WHERE p_adj < 0.05 AND fold > 0) WHERE k <= 50),
    db AS (SELECT dst AS compartment, k AS gene FROM li JOIN cw ON src = CASE WHEN s % 4 = 0 THEN 'X' ELSE ['F', 'O', 'P'][k % 3 + 1] END WHERE s % 3 <> 2),
    cu AS (SELECT CASE k % 2 WHEN 0 THEN 'closed' ELSE 'open' END AS compartment, k AS gene FROM li WHERE s % 10 = 0),
    un AS (FROM re UNION FROM db UNION FROM cu),
    fl AS (SELECT *, (compartment, gene) IN (SELECT (compartment, gene) FROM cu) AS in_curated, (compartment, gene) IN (SELECT (compartment, gene) FROM re) AS in_ref, (compartment, gene) IN (SELECT (compartment, gene) FROM db) AS in_db FROM un)
    SELECT * FROM fl WHERE (in_curated OR (in_ref AND in_db)) AND gene IN (SELECT gene FROM x)""")
def pip_panel_built(spark: SparkSession, sf: str) -> DataFrame:
    """Genes are fifty classes of parts, and a cell's group comes from its highest
    gene, so that there are markers; the database lists the classes."""
    x = t.matrix(spark, sf).groupBy("cell", (F.col("gene") % 50).alias("gene")).agg(F.sum("value").alias("value"))
    listed = t.table(spark, sf, "part").groupBy((F.col("p_partkey") % 50).alias("gene")).agg(F.sum("p_size").alias("s"))
    kind = lambda c: F.element_at(F.array(*map(F.lit, "FOP")), (c % 3 + 1).cast("int"))
    groups = x.groupBy("cell").agg(kind(F.max_by("gene", F.struct("value", F.negative("gene")))).alias("grp"))
    species = F.when(F.col("s") % 3 == 0, "Hs").when(F.col("s") % 3 == 1, "Mm Hs")
    database = listed.select(species.alias("species"), "gene", F.when(F.col("s") % 4 == 0, "X").otherwise(kind(F.col("gene"))).alias("cell_type"))
    curated = listed.where("s % 10 = 0").select(F.when(F.col("gene") % 2 == 0, "closed").otherwise("open").alias("compartment"), "gene")
    return pipelines.panel_built(x, groups, curated, database, relational.vocabulary(spark, {"F": "closed", "O": "open", "P": "pending"}))


@query(f"""WITH {COUNTS}, raw AS (SELECT CAST(p_partkey % 96 AS INTEGER) AS context, 'S' || (p_size % 3) AS signature, CAST(sum(p_retailprice) AS DOUBLE) AS h FROM part GROUP BY 1, 2),
    sig AS (SELECT context, signature, h / sum(h) OVER (PARTITION BY signature) AS h FROM raw), two AS (SELECT context, coalesce(max(h) FILTER (signature = 'S0'), 0) AS a, coalesce(max(h) FILTER (signature = 'S2'), 0) AS b FROM sig WHERE signature IN ('S0', 'S2') GROUP BY 1),
    g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM two),
    enough AS (SELECT * FROM counts WHERE cell IN (SELECT cell FROM counts GROUP BY 1 HAVING sum(n) >= 20)),
    k AS (SELECT cell, coalesce(sum(n * a), 0) AS ta, coalesce(sum(n * b), 0) AS tb FROM enough LEFT JOIN two USING (context) GROUP BY 1),
    f AS (SELECT cell, CASE WHEN tb * aa < ta * ab THEN ta / aa WHEN ta * bb < tb * ab THEN 0 ELSE (ta * bb - tb * ab) / (aa * bb - ab * ab) END AS wa, CASE WHEN ta * bb < tb * ab THEN tb / bb WHEN tb * aa < ta * ab THEN 0 ELSE (tb * aa - ta * ab) / (aa * bb - ab * ab) END AS wb FROM k, g),
    r AS (SELECT cell, context, sum(n) AS n, sum(y) AS y FROM (SELECT cell, context, n, 0 AS y FROM enough UNION ALL SELECT cell, context, 0, wa * a + wb * b FROM f, two) GROUP BY 1, 2)
    SELECT cell, round(corr(n, y), 6) AS pearson, round(sum(n * y) / sqrt(sum(n * n) * sum(y * y)), 6) AS cosine, round(sqrt(sum((n - y) * (n - y))), 4) AS distance,
           CASE WHEN corr(n, y) > 0.8 THEN 'excellent' WHEN corr(n, y) > 0.6 THEN 'good' WHEN corr(n, y) > 0.4 THEN 'moderate' ELSE 'poor' END AS quality FROM r GROUP BY 1""")
def pip_signature_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of prices a size class, two of three asked for and one that
    isn't there: of two the non-negative weights have a closed form."""
    p = t.table(spark, sf, "part").groupBy((F.col("p_partkey") % 96).cast("int").alias("context"), F.concat(F.lit("S"), F.col("p_size") % 3).alias("signature"))
    out = pipelines.signature_refit(t.mutation_counts(spark, sf), p.agg(F.sum("p_retailprice").cast("double").alias("h")), ["S0", "S2", "S9"], threshold=20)["per_cell"]
    return out.select("cell", r6("pearson").alias("pearson"), r6("cosine").alias("cosine"), F.round("distance", 4).alias("distance"), "quality")


@query(f"""WITH {PEARSON}, h AS (SELECT d, count(*) AS m FROM d GROUP BY 1),
    zero AS (SELECT gene, sum(m * greatest(-clip, -(d * g / t) / sqrt(d * g / t + (d * g / t) * (d * g / t) / 100))) AS s, sum(m * power(greatest(-clip, -(d * g / t) / sqrt(d * g / t + (d * g / t) * (d * g / t) / 100)), 2)) AS ss FROM g, h, tot GROUP BY 1),
    more AS (SELECT gene, sum(z - z0) AS s, sum(z * z - z0 * z0) AS ss FROM zf GROUP BY 1),
    a AS (SELECT zero.gene FROM zero LEFT JOIN more USING (gene), tot ORDER BY (zero.ss + coalesce(more.ss, 0)) / n - power((zero.s + coalesce(more.s, 0)) / n, 2) DESC, zero.gene LIMIT 100),
    norm AS (SELECT cell, gene, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell)) AS v FROM x), l AS (SELECT gene, sum(exp(v) - 1) AS s, sum((exp(v) - 1) * (exp(v) - 1)) AS ss FROM norm GROUP BY 1),
    m AS (SELECT gene, ln(1 + s / n) AS mean, ln(greatest(((ss - n * (s / n) * (s / n)) / (n - 1)) / (s / n), 1e-12)) AS dispersion FROM l, tot WHERE s > 0),
    b AS (SELECT *, least(19, floor(coalesce((mean - min(mean) OVER ()) * 20 / nullif(max(mean) OVER () - min(mean) OVER (), 0), 0))) AS bin FROM m),
    z AS (SELECT *, avg(dispersion) OVER (PARTITION BY bin) AS bm, stddev_samp(dispersion) OVER (PARTITION BY bin) AS bs FROM b),
    y AS (SELECT gene, mean, CASE WHEN bs IS NULL OR bs = 0 THEN 1 ELSE (dispersion - bm) / bs END AS dn FROM z),
    c AS (SELECT gene FROM y WHERE mean > 0.0125 AND mean < 5 AND dn > 0.5 ORDER BY dn DESC, gene LIMIT 100)
    SELECT count(*) FILTER (a.gene IS NOT NULL AND c.gene IS NOT NULL) AS n_both, count(*) AS n_either, count(*) FILTER (c.gene IS NULL) AS n_only_a, count(*) FILTER (a.gene IS NULL) AS n_only_b FROM a FULL JOIN c ON a.gene = c.gene""")
def pip_normalisations_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are dear, so that means up to 5 count."""
    return pipelines.normalisations_compared(t.matrix(spark, sf), n_cells(spark, sf), top=100, max_mean=5.0)["overlap"]
