"""Queries that write a file format and read it again, and small expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import consensus, relational, variants
from ..sources import scratch, sinks, tables
from . import pipelines
from . import tables as t
from .registry import X, query

NATION_COUNTS = """nx AS (
    SELECT n_name AS cell, CAST(l_partkey AS VARCHAR) AS gene, sum(l_quantity) AS value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def written_lines(lines: DataFrame, name: str) -> str:
    """A folder of text lines (column value)."""
    path = scratch.new_folder(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


def expression_file(spark: SparkSession, sf: str) -> str:
    """A gene by barcode text table: a row a part, a column a nation."""
    li, s, n = (t.table(spark, sf, x) for x in ("lineitem", "supplier", "nation"))
    counts = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    names = sorted(r[0] for r in n.select("n_name").distinct().collect())
    wide = counts.groupBy(F.col("l_partkey").cast("string").alias("GENE")).pivot("n_name", names).agg(F.sum("l_quantity")).na.fill(0)
    path = scratch.new_folder(spark, "expression")
    sinks.write_text(wide, path)
    return path


@query(f"WITH {NATION_COUNTS} SELECT cell, gene, value FROM nx WHERE value <> 0")
def digital_expression_file(spark: SparkSession, sf: str) -> DataFrame:
    return tables.digital_expression(spark, expression_file(spark, sf)).select("cell", "gene", "value")


def barcode_file(spark: SparkSession, sf: str) -> str:
    """Observed and corrected barcodes of customers, each customer twice."""
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    twice = c.withColumn("o", F.explode(F.array(F.lit("a"), F.lit("b"))))
    lines = twice.select(F.concat_ws("\t", F.concat("o", F.col("k")), F.concat(F.lit("BC"), F.col("k"), F.lit("-1")), F.col("k").cast("double"), (F.col("n") + 0.5).cast("double")).alias("value"))
    return written_lines(lines, "barcodes")


@query("SELECT 'BC' || c_custkey AS barcode, CAST(c_custkey AS DOUBLE) AS x, c_nationkey + 0.5 AS y FROM customer")
def barcode_whitelist_file(spark: SparkSession, sf: str) -> DataFrame:
    names, places = pipelines.whitelist(tables.barcode_matching(spark, barcode_file(spark, sf)))
    return names.join(places, "barcode").select("barcode", "x", "y")


@query("SELECT o_orderkey, o_orderstatus, printf('%.2f', CAST(o_totalprice AS DOUBLE)) AS price FROM orders")
def delimited_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_folder(spark, "delimited")
    own = t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    sinks.write_text(own, path, digits={"price": 2})
    return tables.delimited(spark, path, "o_orderkey bigint, o_orderstatus string, price string")


@query("SELECT o_orderkey, o_custkey, 'sample_' || o_orderstatus AS sample FROM orders")
def sampled_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of files a sample, read together; the path tells the sample."""
    path = scratch.new_folder(spark, "samples")
    orders = t.table(spark, sf, "orders")
    for (status,) in orders.select("o_orderstatus").distinct().collect():  # three states
        sinks.write_text(orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey"), f"{path}/sample_{status}")
    return tables.with_sample(tables.delimited(spark, f"{path}/*", "o_orderkey bigint, o_custkey bigint"))


@query("SELECT o_orderstatus AS chrom, CAST(o_orderkey AS VARCHAR) AS pos, 'PASS' AS filter FROM orders WHERE o_totalprice > 100000")
def commented_file_passed(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    body = o.select(F.concat_ws("\t", "o_orderstatus", "o_orderkey", F.when(F.col("o_totalprice") > 100000, "PASS").otherwise("LowQual")).alias("value"))
    head = spark.createDataFrame([("#chrom\tpos\tfilter",)], "value string")
    df = tables.commented(spark, written_lines(head.unionByName(body), "commented"))
    return df.where(pipelines.passed(F.col("filter"))).select("chrom", "pos", "filter")


@query("""SELECT 'chr' || (l_suppkey % 5) AS chrom, l_partkey AS start, 'C' AS ref, 'T,G' AS alt, 'PASS' AS filter, 'AC' AS up_context, 'GT' AS down_context
    FROM lineitem WHERE l_linenumber <> 3""")
def variant_file(spark: SparkSession, sf: str) -> DataFrame:
    tab = F.lit("\t")
    li = t.table(spark, sf, "lineitem")
    chrom = F.concat(F.lit("chr"), F.col("l_suppkey") % 5)
    full = F.concat_ws("\t", chrom, "l_partkey", "l_partkey", *map(F.lit, ("C", "T,G", "PASS", "x", "AC", "GT", "end")))
    lines = li.select(F.when(F.col("l_linenumber") == 3, F.concat(chrom, tab, F.col("l_partkey"))).otherwise(full).alias("value"))
    head = spark.createDataFrame([("## a comment",), ("Chrom\tStart\tEnd\tREF\tALT\tFILTER\ta\tb\tc\td",)], "value string")
    return tables.variants(spark, written_lines(head.unionByName(lines), "variants"))


@query("SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1")
def sniffed_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_folder(spark, "sniffed")
    sinks.write_text(t.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), path, sep=",")
    df = tables.sniffed(spark, path, ["s_nationkey"])
    return df.groupBy(F.col("s_nationkey").cast("int").alias("nation")).agg(F.count("*").alias("n"))


@query(f"WITH {X} SELECT CAST(cell AS VARCHAR) AS cell, CAST(gene AS VARCHAR) AS gene, value FROM x WHERE value <> 0")
def market_matrix_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_folder(spark, "market")
    sinks.write_market(t.matrix(spark, sf), path)
    return tables.market_matrix(spark, path)


@query("""WITH old AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_size < 10),
    new AS (SELECT 'new' || s_suppkey AS gene FROM supplier)
    SELECT (SELECT count(*) FROM old) + (SELECT count(*) FROM new) AS n_genes, count(*) AS n_entries, CAST(sum(v) AS DOUBLE) AS total
    FROM (SELECT DISTINCT p_partkey, p_size + 1.0 AS v FROM part WHERE p_size < 10)""")
def market_matrix_appended(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_folder(spark, "market")
    x = t.table(spark, sf, "part").where("p_size < 10").select(F.lit("c").alias("cell"), F.col("p_partkey").cast("string").alias("gene"), (F.col("p_size") + 1.0).alias("value"))
    sinks.write_market(x, path)
    sinks.append_features(spark, path, t.table(spark, sf, "supplier").select(F.concat(F.lit("new"), "s_suppkey").alias("gene")))
    n = int(tables.size_line(spark, f"{path}/matrix.mtx").split()[0])
    names = tables.numbered_lines(spark, f"{path}/genes.tsv").agg(F.max("k").alias("k")).where(F.col("k") == n)
    return tables.market_matrix(spark, path).agg(F.count("*").alias("n_entries"), F.sum("value").alias("total")).join(names).select(F.col("k").alias("n_genes"), "n_entries", "total")


@query(f"""WITH {X} SELECT o_orderstatus AS puck, count(*) AS n, sum(value) AS total FROM x JOIN orders ON o_orderkey = cell GROUP BY 1""")
def stored_matrix_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_folder(spark, "stored")
    sinks.write_matrix(t.matrix(spark, sf).join(t.cells(spark, sf).select("cell", "puck"), "cell"), f"{path}/x")
    return tables.annotated(spark, path, "x", ["puck", "value"]).groupBy("puck").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT way, 100.0 / (s_suppkey + 1) AS pct, s_suppkey AS reads, CAST(s_nationkey AS BIGINT) AS tax_reads, 'S' AS rank, CAST(s_suppkey AS VARCHAR) AS taxid,
        'Genus species ' || s_suppkey AS name FROM supplier, (VALUES ('tabs'), ('blanks')) w(way)""")
def taxonomy_listing(spark: SparkSession, sf: str) -> DataFrame:
    s = t.table(spark, sf, "supplier")
    body = s.select(F.concat_ws("\t", F.concat(F.lit("  "), (100.0 / (F.col("s_suppkey") + 1)).cast("string")), "s_suppkey", "s_nationkey", F.lit("S"), "s_suppkey", F.concat(F.lit("  Genus species "), "s_suppkey")).alias("value"))
    head = spark.createDataFrame([("# a listing",), ("too few",)], "value string")
    path = written_lines(head.unionByName(body), "taxonomy")
    return tables.taxonomy(spark, path).withColumn("way", F.lit("tabs")).unionByName(tables.taxonomy(spark, path, whitespace=True).withColumn("way", F.lit("blanks")))


@query("SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY 1, 2")
def filled_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = sinks.filled(t.table(spark, sf, "documents").select("lang", "source", "n_chars"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT o_orderstatus AS puck, count(*) AS n, 1 AS made FROM orders GROUP BY 1")
def staged_once(spark: SparkSession, sf: str) -> DataFrame:
    """A stage asked for twice is made once."""
    path, made = scratch.new_folder(spark, "stages"), []

    def make() -> DataFrame:
        made.append(1)
        return t.cells(spark, sf).groupBy("puck").agg(F.count("*").alias("n"))

    for _ in range(2):
        out = sinks.staged(spark, path, "cells", {"version": 1}, make)
    return out.withColumn("made", F.lit(len(made)))


@query("""SELECT s_suppkey AS supplier_key, s_name AS name_s, s_acctbal AS pred_acct_bal FROM supplier""")
def sanitised_columns(spark: SparkSession, sf: str) -> DataFrame:
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier (key)"), F.col("s_name").alias("name/[s]"), F.col("s_acctbal").alias("pred acct\\bal"), F.col("s_nationkey").alias("other"))
    return pipelines.whitelisted(s.toDF(*map(text.sanitised_name, s.columns)), ["supplier_key", "name_s"], ("pred_",))


@query("""SELECT p_partkey, p_brand AS second, printf('%e', CAST(p_retailprice AS DOUBLE)) AS shown, 'BC' || p_size AS barcode, least(greatest(p_size - 10.0, 0.0), 30.0) AS clipped
    FROM part WHERE p_size % 2 = 0""")
def text_and_number_forms(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("B,C"), "p_size", F.lit("\r"))).otherwise("N,NN")
    out = p.withColumn("barcode", text.cleaned_barcode(raw)).where("barcode IS NOT NULL")
    return out.select("p_partkey", text.second_field(F.concat_ws("|", "p_type", "p_brand")).alias("second"), text.scientific(F.col("p_retailprice")).alias("shown"), "barcode", numeric.clipped(F.col("p_size") - 10.0, 0.0, 30.0).alias("clipped"))


@query("""SELECT a || '[' || s || ']' || b AS context FROM (VALUES ('C>A'), ('C>G'), ('C>T'), ('T>A'), ('T>C'), ('T>G')) x(s),
    (VALUES ('A'), ('C'), ('G'), ('T')) y(a), (VALUES ('A'), ('C'), ('G'), ('T')) z(b)""")
def context_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in variants.contexts96()], "context string")


@query("""WITH v AS (
        SELECT event_id AS cell, event_type AS marker, CASE user_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'ambiguous:' || event_type || '|x' ELSE 'ambiguous:x|y' END AS consensus FROM events)
    SELECT cell, CASE WHEN consensus NOT LIKE 'ambiguous:%' THEN consensus WHEN list_contains(string_split(substr(consensus, 11), '|'), marker) THEN marker ELSE 'unresolved' END AS label FROM v""")
def adjudicated_labels(spark: SparkSession, sf: str) -> DataFrame:
    e, kind = t.table(spark, sf, "events"), F.col("user_id") % 3
    label = F.when(kind == 0, F.col("event_type")).when(kind == 1, F.concat(F.lit("ambiguous:"), "event_type", F.lit("|x"))).otherwise("ambiguous:x|y")
    return e.select(F.col("event_id").alias("cell"), consensus.adjudicated(label, F.col("event_type")).alias("label"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def positional_slice(spark: SparkSession, sf: str) -> DataFrame:
    return relational.positional_slice(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 200)
