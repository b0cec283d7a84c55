"""Queries of quality control, joins, sets, windows and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import consensus, matrix, qc, relational
from ..sources.scratch import stored
from . import tables as t
from .registry import CELLS, GENES, VOTES, X, query, r6

METRICS = f"""{X}, {GENES}, r AS (
        SELECT x.cell, x.value, g.mt, row_number() OVER (PARTITION BY x.cell ORDER BY x.value DESC, x.gene) AS k
        FROM x LEFT JOIN genes g ON x.gene = g.gene WHERE x.value <> 0),
    m AS (
        SELECT cell, count(*) AS n_genes, sum(value) AS total_counts,
               100.0 * sum(value) FILTER (k <= 3) / sum(value) AS pct_top_3,
               coalesce(100.0 * sum(value) FILTER (mt) / sum(value), 0) AS pct_counts_mt
        FROM r GROUP BY cell)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.cell_metrics(t.matrix(spark, sf), t.genes(spark, sf), ("mt",), top=3)


@query(f"""WITH {METRICS}
    SELECT cell, CAST(n_genes AS BIGINT) AS n_genes, total_counts, round(ln(1 + n_genes), 6) AS log1p_n_genes, round(ln(1 + total_counts), 6) AS log1p_total_counts,
           round(pct_top_3, 6) AS pct_top_3, round(pct_counts_mt, 6) AS pct_counts_mt FROM m""")
def qc_cell_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf)
    return m.select("cell", "n_genes", "total_counts", *(r6(c).alias(c) for c in ("log1p_n_genes", "log1p_total_counts", "pct_top_3", "pct_counts_mt")))


@query(f"""WITH {X}, n AS (SELECT count(DISTINCT cell) AS n FROM x)
    SELECT gene, count(*) AS n_cells, sum(value) AS total_counts, round(sum(value) / max(n), 6) AS mean_counts, round(100.0 * (1 - count(*) / max(n)), 6) AS pct_dropout
    FROM x, n WHERE value <> 0 GROUP BY gene""")
def qc_gene_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf)
    n = x.select("cell").distinct().count()
    return matrix.gene_metrics(x, n).withColumns({c: r6(c) for c in ("mean_counts", "pct_dropout")})


FLAGS = f"""{METRICS}, {CELLS},
    c AS (SELECT m.cell, puck, ln(1 + total_counts) AS a, ln(1 + n_genes) AS b, pct_top_3 AS t, pct_counts_mt AS p FROM m JOIN cells USING (cell)),
    med AS (SELECT puck, median(a) AS ma, median(b) AS mb, median(t) AS mt_, median(p) AS mp FROM c GROUP BY puck),
    mad AS (SELECT c.puck, median(abs(a - ma)) AS da, median(abs(b - mb)) AS db, median(abs(t - mt_)) AS dt, median(abs(p - mp)) AS dp FROM c JOIN med ON c.puck = med.puck GROUP BY c.puck),
    f AS (
        SELECT c.cell, c.puck, abs(a - ma) > 3 * da OR abs(b - mb) > 3 * db OR abs(t - mt_) > 3 * dt AS outlier, abs(p - mp) > 3 * dp OR p > 25 AS mt_outlier
        FROM c JOIN med ON c.puck = med.puck JOIN mad ON c.puck = mad.puck)"""


def flags(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell")
    return qc.flagged(m, ["puck"], ["log1p_total_counts", "log1p_n_genes", "pct_top_3"], "pct_counts_mt", nmads=3)


@query(f"WITH {FLAGS} SELECT cell, puck, outlier, mt_outlier FROM f")
def mad_outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    return flags(spark, sf).select("cell", "puck", "outlier", "mt_outlier")


@query(f"""WITH {FLAGS},
    s1 AS (SELECT x.* FROM x JOIN f ON x.cell = f.cell WHERE NOT outlier AND NOT mt_outlier),
    s2 AS (SELECT * FROM s1 WHERE cell IN (SELECT cell FROM s1 GROUP BY cell HAVING count(*) FILTER (value > 0) >= 2)),
    s3 AS (SELECT * FROM s2 WHERE gene IN (SELECT gene FROM s2 GROUP BY gene HAVING count(*) FILTER (value > 0) >= 3)),
    a AS (SELECT puck, count(*) AS before FROM f GROUP BY puck),
    b AS (SELECT puck, count(DISTINCT s3.cell) AS n, count(DISTINCT gene) AS g, sum(value) AS total FROM s3 JOIN cells USING (cell) GROUP BY puck)
    SELECT a.puck, a.before AS cells_before, coalesce(b.n, 0) AS cells_after, round(100.0 * coalesce(b.n, 0) / a.before, 6) AS pct_retained, coalesce(b.g, 0) AS genes_after, coalesce(b.total, 0) AS total_after
    FROM a LEFT JOIN b ON a.puck = b.puck""")
def qc_filter_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = flags(spark, sf)
    kept = qc.filtered(t.matrix(spark, sf), f, min_genes=2, min_cells=3)
    before = f.groupBy("puck").agg(F.count("*").alias("cells_before"))
    after = kept.join(t.cells(spark, sf).select("cell", "puck"), "cell").groupBy("puck").agg(F.count_distinct("cell").alias("cells_after"), F.count_distinct("gene").alias("genes_after"), F.sum("value").alias("total_after"))
    out = before.join(after, "puck", "left").na.fill(0)
    return out.select("puck", "cells_before", "cells_after", r6(100.0 * F.col("cells_after") / F.col("cells_before")).alias("pct_retained"), "genes_after", "total_after")


@query(f"""WITH {METRICS}, {CELLS}, c AS (SELECT puck, m.* FROM m JOIN cells USING (cell))
    SELECT coalesce(puck, 'all') AS puck, count(*) AS cells, sum(total_counts) AS total_umis, median(total_counts) AS median_umis, CAST(median(n_genes) AS DOUBLE) AS median_genes
    FROM c GROUP BY ROLLUP (puck)""")
def puck_summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    m = stored(metrics(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell"), "metrics")
    return qc.with_totals(m, "puck", {"median_umis": "total_counts", "median_genes": "n_genes"}, cells=F.count("*"), total_umis=F.sum("total_counts"))


@query("""SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return relational.keep_first(t.table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25)
    SELECT count(*) AS n_left, count(b.k) AS n_matched, round(100.0 * count(b.k) / count(*), 6) AS match_pct FROM a LEFT JOIN b ON a.k = b.k""")
def inner_match_rate(spark: SparkSession, sf: str) -> DataFrame:
    a = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = t.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("k"))
    return relational.match_rate(a, b, "k")


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, round(coalesce(v, 0), 2) AS total FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_default_zero(spark: SparkSession, sf: str) -> DataFrame:
    per = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    out = relational.joined_or(t.table(spark, sf, "customer").select("c_custkey"), per, ["c_custkey"], {"n_orders": 0, "total": 0.0})
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT p_partkey, q AS max_quantity FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_partkey = p_partkey""")
def left_keep_null(spark: SparkSession, sf: str) -> DataFrame:
    per = t.table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("max_quantity"))
    return t.table(spark, sf, "part").select("p_partkey").join(per, "p_partkey", "left")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def semi_present(spark: SparkSession, sf: str) -> DataFrame:
    big = t.table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    big = t.table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_anti")


@query(f"""WITH {X}, a AS (SELECT * FROM x WHERE gene % 2 = 0), b AS (SELECT * FROM x WHERE gene % 3 = 0), c AS (SELECT cell FROM a INTERSECT SELECT cell FROM b)
    SELECT cell, gene, value, 'left' AS side FROM a WHERE cell IN (SELECT cell FROM c) UNION ALL SELECT cell, gene, value, 'right' FROM b WHERE cell IN (SELECT cell FROM c)""")
def outer_feature_concat(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf)
    return matrix.side_by_side(x.where("gene % 2 = 0"), x.where("gene % 3 = 0"))


@query(f"""WITH {X}, {CELLS} SELECT puck, count(*) AS n, sum(value) AS total FROM cells JOIN x USING (cell) WHERE cell IN (SELECT cell FROM x) GROUP BY puck""")
def label_transfer_gate(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf)
    labelled = t.cells(spark, sf).select("cell", "puck").join(x.select("cell"), "cell", "left_semi")
    return relational.complete_or_raise(labelled, x, "cell").groupBy("puck").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {X}, w AS (SELECT DISTINCT CAST(p_size * 40 AS BIGINT) AS gene FROM part), i AS (SELECT w.gene, count(x.cell) AS n, sum(x.value) AS s FROM w LEFT JOIN x ON w.gene = x.gene GROUP BY 1)
    SELECT gene, n AS n_entries, coalesce(s, 0) AS total FROM i""")
def align_gene_space(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.table(spark, sf, "part").select((F.col("p_size") * 40).cast("long").alias("gene")).distinct()
    some, absent = matrix.aligned(t.matrix(spark, sf), wanted)
    here = some.groupBy("gene").agg(F.count("*").alias("n_entries"), F.sum("value").alias("total"))
    return here.unionByName(absent.select("gene", F.lit(0).cast("long").alias("n_entries"), F.lit(0.0).alias("total")))


@query("SELECT count(*) AS n_shared FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def shared_gene_floor(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("gene"))
    return matrix.shared_or_raise(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), least=10).agg(F.count("*").alias("n_shared"))


@query("""WITH k AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events)
    SELECT k, k IN (SELECT c_custkey FROM customer) AS in_customer, k IN (SELECT o_custkey FROM orders) AS in_orders, k IN (SELECT user_id FROM events) AS in_events FROM k""")
def existence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    own = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
    return relational.existence({n: t.table(spark, sf, n).select(F.col(c).alias("k")) for n, c in own.items()}, "k")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT count(a.k) FILTER (b.k IS NOT NULL) AS n_both, count(*) AS n_either, count(*) FILTER (b.k IS NULL) AS n_only_a, count(*) FILTER (a.k IS NULL) AS n_only_b FROM a FULL JOIN b ON a.k = b.k""")
def name_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("k"))
    return relational.set_sizes(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "k")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH",
    count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1""")
def crosstab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.crosstab(t.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)


@query("""SELECT l_returnflag, round(count(*) FILTER (l_linestatus = 'F') / count(*) FILTER (l_linestatus IN ('F', 'O')), 6) AS "F", round(count(*) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus IN ('F', 'O')), 6) AS "O" FROM lineitem GROUP BY 1""")
def crosstab_row_share(spark: SparkSession, sf: str) -> DataFrame:
    return relational.row_shares(relational.crosstab(t.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]), ["F", "O"])


@query("""SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "A", coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "N", coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY 1""")
def group_sum_unstack(spark: SparkSession, sf: str) -> DataFrame:
    return relational.crosstab(t.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], F.col("l_quantity"))


@query(f"""WITH {X}, {CELLS}, p AS (SELECT puck, x.* FROM x JOIN cells USING (cell)), g AS (SELECT gene FROM p GROUP BY gene HAVING count(DISTINCT puck) = (SELECT count(DISTINCT puck) FROM p))
    SELECT puck, count(*) AS n_entries, count(DISTINCT gene) AS n_genes, sum(value) AS total FROM p WHERE gene IN (SELECT gene FROM g) GROUP BY puck""")
def union_inner_features(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell")
    return matrix.inner_genes(x).groupBy("puck").agg(F.count("*").alias("n_entries"), F.count_distinct("gene").alias("n_genes"), F.sum("value").alias("total"))


@query("""SELECT 'customer' AS series_id, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_outer_columns(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import series

    a = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return series({"customer": a, "supplier": b}).select("series_id", "id", "balance", "segment")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey % 10 AS bin FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 10).alias("bin")).distinct()


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def top_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return relational.top_n(t.table(spark, sf, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def value_counts_pct(spark: SparkSession, sf: str) -> DataFrame:
    return relational.value_counts(t.table(spark, sf, "events"), "event_type")


@query(f"WITH {VOTES} SELECT cluster, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) AS pct FROM votes GROUP BY 1, 2 HAVING count(*) >= 1")
def cluster_composition(spark: SparkSession, sf: str) -> DataFrame:
    return relational.value_counts(t.votes(spark, sf), "cluster", "label", within=["cluster"])


@query(f"WITH {VOTES} SELECT cluster, count(*) AS n FROM votes GROUP BY 1 HAVING count(*) >= 20")
def clusters_with_enough(spark: SparkSession, sf: str) -> DataFrame:
    return t.votes(spark, sf).groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 20")


@query("""SELECT p_partkey, p_brand, CASE WHEN k = 1 THEN p_brand ELSE p_brand || '-' || CAST(k - 1 AS VARCHAR) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)""")
def make_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    return relational.unique_names(t.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", [F.col("p_partkey")])


@query("""WITH v AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN event_type ELSE CAST(user_id % 25 AS VARCHAR) END AS name FROM events)
    SELECT name, row_number() OVER (ORDER BY CASE WHEN regexp_matches(name, '^[0-9]+$') THEN CAST(name AS BIGINT) END NULLS LAST, name) AS place FROM v""")
def numeric_aware_sort(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "events")
    name = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise((F.col("user_id") % 25).cast("string"))
    # a few names, ordered as a whole
    return e.select(name.alias("name")).distinct().withColumn("place", F.row_number().over(Window.orderBy(*relational.natural_order(F.col("name")))).cast("long"))


@query("""WITH v AS (SELECT DISTINCT p_type AS name FROM part)
    SELECT name, row_number() OVER (ORDER BY CASE WHEN contains(lower(name), 'e') THEN 0 ELSE 1 END, name) AS place FROM v""")
def marked_names_first(spark: SparkSession, sf: str) -> DataFrame:
    v = t.table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    return v.withColumn("place", F.row_number().over(Window.orderBy(*relational.marked_first(F.col("name"), "e", F.col("name")))).cast("long"))


@query("""SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 50""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stratified(t.table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 50).select("o_orderstatus", "o_orderkey")


@query(f"""WITH {X}, a AS (SELECT * FROM x WHERE cell IN (SELECT cell FROM x GROUP BY cell HAVING count(*) FILTER (value > 0) >= 3 AND sum(value) >= 50))
    SELECT gene, count(*) AS n_cells, sum(value) AS total FROM a GROUP BY gene HAVING count(*) FILTER (value > 0) >= 5""")
def min_gene_cell_filters(spark: SparkSession, sf: str) -> DataFrame:
    x = matrix.genes_with(matrix.cells_with(t.matrix(spark, sf), 3, 50), 5)
    return x.groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


@query(f"""WITH {X}, n AS (SELECT count(DISTINCT cell) AS n FROM x), g AS (SELECT gene, count(*) AS k, avg(value) AS m FROM x WHERE value > 0 GROUP BY gene)
    SELECT gene FROM g, n WHERE k > 0.03 * n OR (k > 5 AND m > 30)""")
def permissive_gene_filter(spark: SparkSession, sf: str) -> DataFrame:
    x = t.matrix(spark, sf)
    return matrix.permissive_genes(x, x.select("cell").distinct().count(), nonzero_mean=30)


@query(f"""WITH v AS (SELECT 'g' || CAST(gene AS VARCHAR) AS name FROM (SELECT DISTINCT l_partkey % 500 AS gene FROM lineitem))
    SELECT name, row_number() OVER (ORDER BY name) AS id FROM v""")
def coo_dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    names = t.table(spark, sf, "lineitem").select(F.concat(F.lit("g"), (F.col("l_partkey") % 500).cast("string")).alias("name"))
    return matrix.dense_ids(names, "name", "id")


# labels


def _consensus(sql_flat: str, score: str) -> str:
    return f"""WITH {VOTES}, a AS (SELECT *, {score} AS s, min({score}) OVER w AS lo, max({score}) OVER w AS hi, count(*) OVER w AS n FROM votes WINDOW w AS (PARTITION BY cluster)),
    b AS (SELECT *, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE {sql_flat} END AS z FROM a),
    c AS (SELECT *, CASE WHEN sum(z) OVER (PARTITION BY cluster) <> 0 THEN z / sum(z) OVER (PARTITION BY cluster) ELSE 1.0 / n END AS wt FROM b),
    d AS (SELECT cluster, label, sum(s * wt) AS score FROM c GROUP BY 1, 2),
    e AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC NULLS LAST, label) AS r FROM d)
    SELECT cluster, label, round(score, 6) AS score FROM e WHERE r = 1"""


@query(_consensus("0", "score"))
def cluster_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.dominant(consensus.cluster_scores(t.votes(spark, sf))).select("cluster", "label", r6("score").alias("score"))


@query(_consensus("1.0 / n", "coalesce(score, 0)"))
def cluster_consensus_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.dominant(consensus.cluster_scores(t.votes(spark, sf), "uniform")).select("cluster", "label", r6("score").alias("score"))


@query(f"""WITH {VOTES}, d AS (SELECT cluster, label, count(*) AS score FROM votes GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, label) AS r FROM d), m AS (SELECT cluster, label, avg(score) AS c FROM votes GROUP BY 1, 2)
    SELECT e.cluster, e.label, e.score, round(m.c, 6) AS cluster_confidence FROM e JOIN m ON e.cluster = m.cluster AND e.label = m.label WHERE r = 1""")
def cluster_majority(spark: SparkSession, sf: str) -> DataFrame:
    v = t.votes(spark, sf)
    return consensus.with_confidence(consensus.majority(v), v).withColumn("cluster_confidence", r6("cluster_confidence")).select("cluster", "label", "score", "cluster_confidence")


VOCABULARY = {"AFRICA": "south", "AMERICA": "west", "ASIA": "east", "EUROPE": "west"}


@query("""WITH v(src, dst) AS (VALUES ('AFRICA', 'south'), ('AMERICA', 'west'), ('ASIA', 'east'), ('EUROPE', 'west')),
    n AS (SELECT c_custkey, r.r_name AS a, r2.r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r.r_regionkey JOIN region r2 ON (n_regionkey + c_custkey % 3) % 5 = r2.r_regionkey),
    m AS (SELECT c_custkey, coalesce(x.dst, 'unresolved') AS ac, coalesce(y.dst, 'unresolved') AS bc FROM n LEFT JOIN v x ON n.a = x.src LEFT JOIN v y ON n.b = y.src)
    SELECT c_custkey, ac AS a_coarse, bc AS b_coarse, CASE WHEN ac = bc THEN 'agree' ELSE 'disagree' END AS agreement, CASE WHEN ac = bc THEN ac ELSE 'ambiguous:' || ac || '|' || bc END AS label FROM m""")
def harmonize_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (t.table(spark, sf, x) for x in ("customer", "nation", "region"))
    two = c.join(n, c.c_nationkey == n.n_nationkey).join(r.select("r_regionkey", F.col("r_name").alias("a")), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")
    two = two.join(r.select("r_regionkey", F.col("r_name").alias("b")), (F.col("n_regionkey") + F.col("c_custkey") % 3) % 5 == F.col("r_regionkey"))
    out = consensus.reconciled(two.select("c_custkey", "a", "b"), "a", "b", relational.vocabulary(spark, VOCABULARY))
    return out.select("c_custkey", "a_coarse", "b_coarse", "agreement", "label")


@query("""SELECT count(*) AS n, round(avg(CASE WHEN l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END THEN 1.0 ELSE 0 END), 6) AS rate FROM lineitem""")
def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").withColumn("b", F.when(F.col("l_linestatus") == "F", "A").otherwise("N"))
    return li.agg(F.count("*").alias("n"), r6(consensus.agreement_rate(li, "l_returnflag", "b")).alias("rate"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label, round(list_reverse_sort([a, b, c])[1], 6) AS top, round(list_reverse_sort([a, b, c])[1] - list_reverse_sort([a, b, c])[2], 6) AS margin FROM s""")
def row_argmax_margin(spark: SparkSession, sf: str) -> DataFrame:
    label, top, margin = numeric.best_two([("a", F.col("l_discount") * 10), ("b", F.col("l_tax") * 10), ("c", F.col("l_quantity") / 50)])
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), r6(top).alias("top"), r6(margin).alias("margin"))


@query(f"""WITH v AS (SELECT CAST(user_id % 40 AS VARCHAR) AS cluster, event_type AS label, greatest(value - 50, 0) AS m FROM events),
    s AS (SELECT cluster, label, sum(m) AS score FROM v GROUP BY 1, 2),
    r AS (SELECT *, sum(score) OVER (PARTITION BY cluster) AS t, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, label) AS k FROM s)
    SELECT cluster, label, round(score, 6) AS score, round(CASE WHEN t = 0 THEN 0 ELSE score / t END, 6) AS confidence FROM r WHERE k = 1""")
def weighted_cluster_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = t.votes(spark, sf).withColumn("margin", F.col("score") - 50)
    return consensus.margin_vote(v, "cluster", "label", "margin").select("cluster", "label", r6("score").alias("score"), r6("confidence").alias("confidence"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_value, count(*) AS size FROM orders GROUP BY 1")
def group_first_size(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.first_and_size(t.table(spark, sf, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey"))


# strings


@query("""SELECT p_partkey, starts_with(p_type, 'S') OR starts_with(p_type, 'L') AS prefixed, regexp_matches(p_type, '^E[^(C)]') AS flagged, regexp_replace(p_brand || '-1', '-1$', '') AS bare, split_part(p_type, ' ', 1) AS head,
    p_brand || '_' || CAST(p_size AS VARCHAR) AS key, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS label FROM part""")
def string_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    return p.select(
        "p_partkey", text.has_prefix(F.col("p_type"), "S", "L").alias("prefixed"), F.col("p_type").rlike("^E[^(C)]").alias("flagged"), text.without_suffix(F.concat("p_brand", F.lit("-1"))).alias("bare"),
        text.before(F.col("p_type"), " ").alias("head"), text.composite(F.col("p_brand"), F.col("p_size")).alias("key"), text.sanitised_label(F.col("p_name")).alias("label"),
    )


@query("""SELECT event_id, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s ELSE substr(regexp_extract(s, '\\(([^)]+)', 1), 7) END AS taxid
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type || ' (taxid ' || CAST(user_id AS VARCHAR) || ')' END AS s FROM events)""")
def taxid_parse(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat(F.col("event_type"), F.lit(" (taxid "), F.col("user_id").cast("string"), F.lit(")"))
    s = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(named)
    return t.table(spark, sf, "events").select("event_id", text.taxid(s).alias("taxid"))


@query("""SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 'hot' WHEN contains(lower(o_orderpriority), 'low') THEN 'cold' ELSE 'other' END AS bucket FROM orders""")
def keyword_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select("o_orderkey", text.keyword_bucket(F.col("o_orderpriority"), [("hot", ["urgent", "high"]), ("cold", ["low"])]).alias("bucket"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS n_flags FROM lineitem GROUP BY 1""")
def list_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    lists = t.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("a"))
    as_text = lists.select("l_orderkey", text.joined(F.col("a")).alias("flags"))
    return as_text.withColumn("n_flags", F.size(numeric.union_of(text.parted(F.col("flags")), text.parted(F.col("flags")))))
