"""Mutational signatures: refitting, reconstruction and choice.

Long tables: counts (cell, context, n), signatures (context, signature, h),
weights (cell, signature, w).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(signatures: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Signatures whose sums are off 1 by more than the tolerance, made to sum to
    1 (STA22)."""
    sums = signatures.groupBy("signature").agg(F.sum("h").alias("__s"))
    return signatures.join(sums, "signature").withColumn("h", F.when(F.abs(F.col("__s") - 1) > tolerance, F.try_divide("h", "__s")).otherwise(F.col("h"))).drop("__s")


def chosen(signatures: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The signatures asked for, and the names that aren't there (STA22)."""
    there = {r["signature"] for r in signatures.where(F.col("signature").isin(names)).select("signature").distinct().collect()}
    return signatures.where(F.col("signature").isin(names)), [n for n in names if n not in there]


def nnls(h: np.ndarray, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The non-negative weights that bring h @ w nearest to x, by the active-set
    method of Lawson and Hanson."""
    n = h.shape[1]
    w, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = h.T @ h, h.T @ x
    tol = 10 * np.finfo(float).eps * max(1.0, np.abs(gram).sum(axis=0).max()) * n
    for _ in range(rounds or 3 * n + 10):
        slope = target - gram @ w
        slope[passive] = -np.inf
        if passive.all() or slope.max() <= tol:
            break
        passive[int(slope.argmax())] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            if (s > 0).all():
                w[:] = 0
                w[own] = s
                break
            bad = s <= 0
            step = (w[own][bad] / np.maximum(w[own][bad] - s[bad], 1e-300)).min()
            w[own] += step * (s - w[own])
            passive[own[w[own] <= 1e-14]] = False
            w[~passive] = 0
            if not passive.any():
                break
    return w


def _matrix(signatures: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """The signatures as a dense matrix on the driver: 96 contexts and some
    dozens of columns, whatever the number of cells."""
    rows = signatures.select("context", "signature", "h").collect()
    contexts, names = sorted({r["context"] for r in rows}), sorted({r["signature"] for r in rows})
    h = np.zeros((len(contexts), len(names)))
    for r in rows:
        h[contexts.index(r["context"]), names.index(r["signature"])] += r["h"]
    return contexts, names, h


def exposures(counts: DataFrame, signatures: DataFrame) -> DataFrame:
    """cell, signature, w, residual: the non-negative refit of each cell, zeros
    too (STA18).  A cell's counts are one row of a map; no cell is shuffled
    beyond that."""
    contexts, names, h = _matrix(signatures)
    shared = counts.sparkSession.sparkContext.broadcast((contexts, names, h))

    def work(batches):
        contexts, names, h = shared.value
        for batch in batches:
            at = 0
            for some in _dense(batch.column(1), contexts):
                fits = [nnls(h, x) for x in some]
                cells = batch.column(0).slice(at, len(some)).take(pa.array(np.repeat(np.arange(len(some)), len(names))))
                off = [float(np.linalg.norm(x - h @ w)) for x, w in zip(some, fits, strict=True)]
                yield pa.record_batch([cells, pa.array(names * len(some), pa.string()), pa.array(np.concatenate(fits)), pa.array(np.repeat(off, len(names)))], names=["cell", "signature", "w", "residual"])
                at += len(some)

    kind = dict(counts.dtypes)["cell"]
    return _per_cell(counts).mapInArrow(work, f"cell {kind}, signature string, w double, residual double")


def reconstruction(counts: DataFrame, signatures: DataFrame, weights: DataFrame) -> DataFrame:
    """cell, context, n, fitted over all contexts of the signatures (STA19).

    A cell's counts and weights meet first, and its contexts are laid out there: tasks
    are as many as the counts need, not as few as the small table of weights.
    """
    entry = "struct<context:{},n:double,fitted:double>".format(dict(counts.dtypes)["context"])
    weight = "struct<signature:string,w:double>"
    per_context = signatures.groupBy("context").agg(F.collect_list(F.struct("signature", "h")).alias("hs"))
    shape = per_context.agg(F.collect_list(F.struct("context", "hs")).alias("__shape"))  # one row: a row a context and signature
    seen = counts.select("cell", F.struct("context", F.col("n").cast("double").alias("n"), F.lit(0.0).alias("fitted")).cast(entry).alias("e"), F.lit(None).cast(weight).alias("x"))
    fits = weights.where("w <> 0").select("cell", F.lit(None).cast(entry).alias("e"), F.struct(F.col("signature").cast("string").alias("signature"), F.col("w").cast("double").alias("w")).cast(weight).alias("x"))
    met = seen.unionByName(fits).groupBy("cell").agg(F.collect_list("e").alias("es"), F.collect_list("x").alias("xs"))

    def fitted(hs: Column) -> Column:
        own = lambda x: F.aggregate(F.filter(hs, lambda h: h["signature"] == x["signature"]), F.lit(0.0), lambda t, h: t + x["w"] * h["h"])
        return F.aggregate("xs", F.lit(0.0), lambda t, x: t + own(x))

    reached = F.filter("__shape", lambda c: F.exists("xs", lambda x: F.exists(c["hs"], lambda h: h["signature"] == x["signature"])))
    laid = F.transform(reached, lambda c: F.struct(c["context"].alias("context"), F.lit(0.0).alias("n"), fitted(c["hs"]).alias("fitted")).cast(entry))
    rows = met.join(F.broadcast(shape)).select("cell", F.explode(F.concat("es", laid)).alias("e")).select("cell", "e.*")
    return rows.groupBy("cell", "context").agg(F.sum("n").alias("n"), F.sum("fitted").alias("fitted"))


def errors(both: DataFrame, n_contexts: int = 96) -> DataFrame:
    """frobenius, relative, mae, rmse and rate over all cells; contexts that a
    cell lacks on both sides count as right (STA19)."""
    off = F.col("n") - F.col("fitted")
    sums = both.agg(F.sum(off**2).alias("ss"), F.sum(F.abs(off)).alias("sa"), F.sum(F.col("n") ** 2).alias("nn"), F.sum("n").alias("t"), F.count_distinct("cell").alias("c"))
    size = F.col("c") * n_contexts
    return sums.select(F.sqrt("ss").alias("frobenius"), F.sqrt(F.try_divide("ss", "nn")).alias("relative"), F.try_divide(F.col("sa"), size).alias("mae"), F.sqrt(F.try_divide(F.col("ss"), size)).alias("rmse"), (1 - F.try_divide("sa", "t")).alias("rate"))


def summary(weights: DataFrame, least: float = 0.1) -> DataFrame:
    """mean, median, max and share of cells over ``least`` a signature (AGG20)."""
    return weights.groupBy("signature").agg(F.avg("w").alias("mean"), F.median("w").alias("median"), F.max("w").alias("max"), F.avg((F.col("w") > least).cast("double")).alias("detection"))


def quality(pearson: str) -> Column:
    """Bins of a reconstruction's correlation (AGG21)."""
    c = F.col(pearson)
    return F.when(c > 0.8, "excellent").when(c > 0.6, "good").when(c > 0.4, "moderate").otherwise("poor")


def _dense(column: pa.Array, contexts: list, some: int = 1024) -> Iterator[np.ndarray]:
    """Cells x contexts of a column of lists of (context, n), ``some`` cells at a
    time; contexts that aren't asked for are left out."""
    wanted = pa.array(contexts)
    for at in range(0, len(column), some):
        own = column.slice(at, some)
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        entries = own.flatten()
        context, n = entries.field(0), pc.fill_null(entries.field(1), 0.0)
        place = pc.fill_null(pc.index_in(context, wanted.cast(context.type)), -1).to_numpy(zero_copy_only=False)
        there = place >= 0
        which = np.repeat(np.arange(len(own)), size)[there] * len(contexts) + place[there]
        yield np.bincount(which, n.to_numpy(zero_copy_only=False)[there], len(own) * len(contexts)).astype(np.float64).reshape(len(own), len(contexts))


def _per_cell(counts: DataFrame) -> DataFrame:
    """cell, m: a row a cell with its contexts and counts."""
    return counts.groupBy("cell").agg(F.collect_list(F.struct("context", F.col("n").cast("double").alias("n"))).alias("m"))


def gram(counts: DataFrame, contexts: list[str]) -> np.ndarray:
    """contexts x contexts inner products over all cells.  Tasks send sums of
    their cells, so the driver gets one small matrix a task."""

    def work(batches):
        total = np.zeros((len(contexts), len(contexts)))
        for batch in batches:
            for rows in _dense(batch.column(0), contexts):
                total += rows.T @ rows
        yield pa.record_batch([pa.array(total.ravel()), pa.array(np.arange(total.size))], names=["v", "k"])

    out = np.zeros(len(contexts) ** 2)
    for r in _per_cell(counts).select("m").mapInArrow(work, "v double, k bigint").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out.reshape(len(contexts), len(contexts))


def spectrum(counts: DataFrame, contexts: list[str]) -> DataFrame:
    """rank, singular_value, variance, cumulative and least_error: of the count
    matrix, and the smallest error that any fit of that rank has (STA20)."""
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(gram(counts, contexts))[::-1], 0))
    share = values**2 / max((values**2).sum(), 1e-300)
    rest = np.sqrt(np.maximum((values**2).sum() - np.cumsum(values**2), 0))
    rows = [(k + 1, float(v), float(s), float(c), float(e)) for k, (v, s, c, e) in enumerate(zip(values, share, np.cumsum(share), rest, strict=True))]
    return counts.sparkSession.createDataFrame(rows, "rank int, singular_value double, variance double, cumulative double, least_error double")


def elbow(errors: list[float]) -> int:
    """Index where the second differences are largest (WIN8)."""
    if len(errors) < 3:
        return max(0, len(errors) - 1)
    return int(np.gradient(np.gradient(np.array(errors, float))).argmax())


def scree(counts: DataFrame, signatures: DataFrame, core: list[str], candidates: list[str], least_gain: float = 0.01) -> tuple[list[str], DataFrame]:
    """The signatures chosen and the scree: candidates by the variance that each
    explains alone, added one by one to the core; the elbow or the first gain
    under ``least_gain``, whichever comes first (STA21, WIN9).

    The fits of all sets run as one job over the cells: the sets are few, the
    cells many.
    """
    contexts, names, h = _matrix(signatures)
    total = counts.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0

    def error(sets: list[list[str]]) -> list[float]:
        def work(batches):
            out, columns = np.zeros(len(sets)), [h[:, [names.index(s) for s in some]] for some in sets]
            for batch in batches:
                for rows in _dense(batch.column(0), contexts):
                    for x in rows:
                        for j, own in enumerate(columns):
                            out[j] += float(((x - own @ nnls(own, x)) ** 2).sum())
            yield pa.record_batch([pa.array(np.arange(len(sets))), pa.array(out)], names=["k", "v"])

        sums = {r["k"]: r["v"] for r in _per_cell(counts).select("m").mapInArrow(work, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        return [sums.get(k, 0.0) for k in range(len(sets))]

    known = [c for c in candidates if c in names]
    alone = dict(zip(known, error([[c] for c in known]), strict=True)) if known else {}
    ordered = sorted(known, key=lambda c: (alone[c], c))
    sets = [core + ordered[:k] for k in range(len(ordered) + 1) if core + ordered[:k]]
    found = error(sets)
    explained = [1 - e / total if total else 0.0 for e in found]
    gains = [0.0] + [b - a for a, b in zip(explained, explained[1:], strict=False)]
    small = next((k - 1 for k in range(1, len(sets)) if gains[k] < least_gain), len(sets) - 1)
    pick = max(0, min(elbow([e**0.5 for e in found]), small))
    rows = [(len(s), s[-1], float(e**0.5), float(x), float(g)) for s, e, x, g in zip(sets, found, explained, gains, strict=True)]
    return sets[pick], counts.sparkSession.createDataFrame(rows, "n_signatures int, added string, error double, explained double, gain double")
