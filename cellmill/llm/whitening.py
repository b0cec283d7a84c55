"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Components are whole numbers, floor(SCALE * c), so their centred scatter is a
matrix of whole numbers, too wide for a double or a long.  Each task takes its
rows modulo several primes: residues are below 2 ** 21, so that a product of
CHUNK rows stays exact in doubles and a matrix product of residues is a plain
one.  Sums modulo the primes are added by Spark, and the Chinese remainder
theorem gives the exact entries; their number of primes follows from the
largest component and the number of rows.  The only rounding is that of each
exact entry to a double, before its eigenvectors are taken.

Rows are centred before they are multiplied: with n fit rows and sums S the
scatter is that of n * x - S.

Edge cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors are filled with zeros to the longest; components beyond
a long's range are the largest or smallest long; each distinct vector is fitted
once, however often it occurs; rows of equal or null ids keep a row each; with
fewer dimensions than components asked, all dimensions; a component without
variance (one distinct vector, or collinear ones) has whitened 0 and takes no
part in the identity error; an empty table, or empty vectors alone, give no
rows; ``deviation`` is null where it passes 63 bits, ``deviation_digits`` holds
it in any case; extra columns are ignored.

What the driver holds follows the dimensions alone: a sum a dimension, and an
entry a prime and pair of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

SCALE = 256
#: Primes are below 2 ** PRIME_BITS; centred residues then have PRIME_BITS - 1
#: bits, and CHUNK products of them stay below 2 ** 53.
PRIME_BITS, CHUNK = 21, 4096


@dataclass(frozen=True)
class Whitening:
    """n fit rows, exact sums a dimension, eigenvectors (a column each, by falling
    eigenvalue), eigenvalues and the exact trace's double."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def directions(self, most: int) -> np.ndarray:
        """The first components over the roots of their eigenvalues, 0 without variance."""
        e = self.values[:most]
        real = e > len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0) if len(e) else e > 0
        return self.axes[:, :most] * np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS, as many as make a product over ``bound``."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for k in range(2, 1 << (PRIME_BITS + 1) // 2):
        if sieve[k]:
            sieve[k * k :: k] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            return out
        out.append(p)
        product *= p
    raise ValueError("no primes left")


def whole(vector: Column) -> Column:
    """array<bigint>: floor(SCALE * c) of each component; null for a vector that
    is null or holds null or non-finite components."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda c: F.floor(SCALE * c)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a batch's column of equal lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def totals(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...], int]:
    """(rows, exact sums, largest absolute component) of ``fit`` (x)."""

    def work(batches):
        n, most, high, low = 0, 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            if len(x):
                n += len(x)
                most = max(most, int(x.max()), -int(x.min()))
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        columns = [np.arange(d), high, low, np.full(d, n)]
        yield pa.record_batch([*map(pa.array, columns), pa.array([str(most)] * d)], names=["j", "high", "low", "n", "most"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.mapInArrow(work, "j bigint, high bigint, low bigint, n bigint, most string")
    rows = parts.groupBy("j").agg(exact("high"), exact("low"), F.sum("n").alias("n"), F.max(F.col("most").cast("decimal(38,0)")).alias("most")).orderBy("j").collect()
    return rows[0]["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows), max(int(r["most"]) for r in rows)


def residue_scatter(batches, d: int, n: int, sums: tuple[int, ...], moduli: list[int]):
    """Rows (k, i, row): row i, from its diagonal on, of the scatter of n * x - S
    modulo prime k, of one task's rows."""
    out = [np.zeros((d, d), np.int64) for _ in moduli]
    for batch in batches:
        x = matrix(batch.column(0), d)
        for at in range(0, len(x), CHUNK):
            for k, p in enumerate(moduli):
                y = (x[at : at + CHUNK] % p * (n % p) - np.array([s % p for s in sums], np.int64)) % p
                y = (y - np.where(y > p // 2, p, 0)).astype(np.float64)
                out[k] = (out[k] + (y.T @ y).astype(np.int64)) % p
    for k in range(len(moduli)):
        rows = [out[k][i, i:] for i in range(d)]
        yield pa.record_batch([pa.array(np.full(d, k)), pa.array(np.arange(d)), pa.array(rows, pa.list_(pa.int64()))], names=["k", "i", "row"])


def scatter(fit: DataFrame, d: int, n: int, sums: tuple[int, ...], most: int) -> np.ndarray:
    """d x d Python integers: the exact scatter of n * x - S over ``fit`` (x)."""
    moduli = primes(2 * n * (2 * n * most) ** 2 + 1)
    parts = fit.mapInArrow(lambda b: residue_scatter(b, d, n, sums, moduli), "k bigint, i bigint, row array<bigint>")
    sums_ = parts.select("k", "i", F.posexplode("row").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    residues = np.zeros((len(moduli), d, d), object)
    k, i, j, v = (sums_[c].to_numpy() for c in ("k", "i", "j", "v"))
    residues[k, i, i + j] = v
    product = reduce(lambda a, b: a * b, moduli, 1)
    out = np.zeros((d, d), object)
    for p, r in zip(moduli, residues, strict=True):
        rest = product // p
        out = (out + r % p * (rest * pow(rest, -1, p))) % product
    out = np.where(out > product // 2, out - product, out)
    return np.triu(out) + np.triu(out, 1).T


def fitted(fit: DataFrame, d: int) -> Whitening:
    """The whitening of the rows of ``fit`` (x, lists of d), each counted once."""
    n, sums, most = totals(fit, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, d)), np.zeros(d), 0.0)
    exact = scatter(fit, d, n, sums, most)
    covariance = np.array([[v / n**3 for v in row] for row in exact.tolist()], np.float64)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return Whitening(n, sums, axes, values[::-1], sum(exact[k, k] for k in range(d)) / n**3)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Python integers: the sum of (n * x - S) ** 2 of each row, exact."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    wide = x.shape[1] * most * max(most, *map(abs, sums), 1) >= 1 << 62
    x = x.astype(object) if wide else x
    squares, cross = (x * x).sum(axis=1), (x * np.array(sums, object if wide else np.int64)).sum(axis=1)
    return squares.astype(object) * (n * n) - cross.astype(object) * (2 * n) + sum(s * s for s in sums)


def projected(x: np.ndarray, model: Whitening, most: int) -> np.ndarray:
    return (x - np.array([s / model.n for s in model.sums])) @ model.directions(most)


COLUMNS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, deviation_digits string"


def whitened(vectors: DataFrame, components: int = 4, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and
    deviation_digits for every row that takes part and each of the first
    ``components`` components."""
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(id_col).cast("long").alias("i"), whole(F.col(vector_col)).alias("x")).where("x IS NOT NULL"), "whole-vectors")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], COLUMNS).withColumn("identity_error", F.lit(0.0))
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(d) - F.size("x"), F.lit(0))))
    rows = rows.select("i", filled.alias("x"))
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    model = fitted(fit, d)
    many = min(components, d)
    share = model.values[:many] / model.trace if model.trace > 0 else np.zeros(many)

    def spread(batches):
        for batch in batches:
            w = projected(matrix(batch.column(0), d), model, many)
            yield pa.record_batch([pa.array(w[:, k]) for k in range(many)], names=[f"w{k}" for k in range(many)])

    pairs = [(a, b) for a in range(many) for b in range(a, many)]
    cov = fit.mapInArrow(spread, ", ".join(f"w{k} double" for k in range(many))).agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    real = model.directions(many).any(axis=0)
    error = max([0.0, *(abs(c - (a == b)) for c, (a, b) in zip(cov, pairs, strict=True) if real[a] and real[b])])

    def work(batches):
        for batch in batches:
            x = matrix(batch.column(1), d)
            w, exact = projected(x, model, many), deviations(x, model.n, model.sums).tolist()
            each = np.repeat(np.arange(len(x)), many)
            number = np.tile(np.arange(many), len(x))
            fits = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            columns = [batch.column(0).take(pa.array(each)), pa.array(number + 1, pa.int32()), pa.array(np.full(len(each), model.n)), fits.take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(share[number]), pa.array(list(map(str, exact)), pa.string()).take(pa.array(each))]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_digits"])

    return rows.mapInArrow(work, COLUMNS).withColumn("identity_error", F.lit(float(error)))
