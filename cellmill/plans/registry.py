"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The driver's tables in the domain's roles, as in cellmill.plans.tables.
X = "x AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
CELLS = "cells AS (SELECT o_orderkey AS cell, o_orderstatus AS puck, o_totalprice AS depth, CAST(o_custkey % 997 AS DOUBLE) AS x, CAST(o_orderkey % 1009 AS DOUBLE) AS y FROM orders)"
GENES = "genes AS (SELECT p_partkey AS gene, p_type AS name, p_size <= 5 AS mt, p_size > 45 AS ribo FROM part)"
VOTES = "votes AS (SELECT event_id AS cell, CAST(user_id % 40 AS VARCHAR) AS cluster, event_type AS label, value AS score FROM events)"
READS = "reads AS (SELECT user_id % 100 AS cb, event_id % 7 AS ub, event_type AS taxid FROM events)"
CODES = """letters AS (SELECT doc_id AS site, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS b FROM documents),
    codes AS (SELECT site, substr(b, i + 1, 1) AS ref, substr(b, i + 2, 1) AS alt, substr(b, i, 3) AS context FROM (SELECT site, b, unnest(range(1, length(b) - 1)) AS i FROM letters))"""
COUNTS = "counts AS (SELECT l_suppkey AS cell, CAST(l_partkey % 96 AS INTEGER) AS context, count(*) AS n FROM lineitem GROUP BY 1, 2)"
SIGNATURES = """sig AS (
    SELECT context, 'S' || s AS signature, (1 + (context * (s + 2)) % 7) / sum(1 + (context * (s + 2)) % 7) OVER (PARTITION BY s) AS h
    FROM (SELECT CAST(c AS INTEGER) AS context FROM range(96) t(c)), (SELECT CAST(c AS INTEGER) AS s FROM range(4) u(c)))"""


def query(sql: str | None = None):
    """Register a function as a query of its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scores_sql(name: str, panel: str, bins: int = 25, control: int = 50) -> str:
    """Tables that end in <name>_ms (cell, compartment, score), module scores of
    the table ``panel`` over norm and nc."""
    at = [k / bins for k in range(1, bins)]
    return f"""{name}_mean AS (SELECT gene, sum(v) / max(n) AS mean FROM norm, nc GROUP BY gene), {name}_ed AS (SELECT quantile_cont(mean, {at}) AS e FROM {name}_mean),
    {name}_bins AS (SELECT gene, 1 + len(list_filter(e, lambda q: q < mean)) AS bin FROM {name}_mean, {name}_ed),
    {name}_own AS (SELECT p.*, bin FROM {panel} p JOIN {name}_bins USING (gene)),
    {name}_cand AS (SELECT DISTINCT o.compartment, o.bin, b.gene FROM {name}_own o JOIN {name}_bins b ON b.bin = o.bin WHERE (o.compartment, b.gene) NOT IN (SELECT (compartment, gene) FROM {panel})),
    {name}_pick AS (SELECT compartment, gene FROM (SELECT *, row_number() OVER (PARTITION BY compartment, bin ORDER BY md5('0:' || compartment || ':' || CAST(gene AS VARCHAR)), gene) AS r FROM {name}_cand) WHERE r <= {control}),
    {name}_wt AS (SELECT compartment, gene, 1.0 / count(*) OVER (PARTITION BY compartment) AS w FROM {name}_own UNION ALL SELECT compartment, gene, -1.0 / count(*) OVER (PARTITION BY compartment) FROM {name}_pick),
    {name}_ms AS (SELECT cell, compartment, sum(v * w) AS score FROM norm JOIN {name}_wt USING (gene) GROUP BY 1, 2)"""


def best_sql(name: str) -> str:
    return f"{name}_best AS (SELECT cell, compartment AS label FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, compartment) AS r FROM {name}_ms) WHERE r = 1)"


#: The two-sided p of a score whose absolute value over sqrt(2) is u: a series of
#: the error function, beyond 2.5 a continued fraction.
P_SQL = """CASE WHEN u < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-u * u) * list_sum(list_transform(range(0, 61), lambda i: pow(u, 2 * i + 1) * pow(4.0, i) * gamma(i + 1) / gamma(2 * i + 2)))
           ELSE exp(-u * u) / sqrt(pi()) / list_reduce(list_concat([u], list_transform(range(60, 0, -1), lambda i: CAST(i AS DOUBLE))), lambda a, i: u + (i / 2.0) / a) END"""
