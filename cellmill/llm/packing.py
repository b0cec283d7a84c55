"""Documents packed into sequences of WIDTH tokens, with few cuts and no padding.

A document's ids, its end id included, are cut at multiples of WIDTH; each whole
block is a sequence.  What is left (a tail) is packed as a cutting-stock problem:

1. A histogram counts tails by length in units of GRAIN ids, rounded up.  A
   linear program chooses how often each pattern (a multiset of lengths that
   fits a sequence) is used; columns are generated as needed, priced by a
   knapsack dynamic program over its dual values.  Patterns are used as often
   as their rounded share says, and what rounding leaves is packed longest
   first.  All of this sees a histogram and runs on the driver.
2. Tails are ranked within their length, and each rank belongs to one use of
   one pattern: that is its sequence.
3. The gaps that are left (by rounding to units, by lengths that don't add up)
   are filled with a stream of tails that were set aside by a hash, just as
   many as the gaps need.  Only these tails are cut.  What the stream has left
   makes whole sequences, and its end sequences of powers of two.

So no sequence is padded, and if no pattern leaves few gaps (all tails a bit
over half a sequence, say) more tails are set aside, up to all of them.

Edge cases: a null text has the end id alone; rows of equal or null ids are
documents of their own; a document of a multiple of WIDTH ids has no tail; an
empty table gives an empty table; extra columns are ignored; texts of any
length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binpack import worker_encoder
from .bpe import shared_vocabulary
from .scratch import written
from .textbatch import gathered, pieces, plain

WIDTH = 2048
#: Lengths are counted in units of so many ids: finer ones leave smaller gaps,
#: and the linear program takes longer.
GRAIN = 16
#: Tails are set aside in steps of 1 / SLICES of all.
SLICES = 256
#: Changes of the linear program's basis, at most so many a length; its last
#: basis is used in any case.
PIVOTS = 40
#: Tails that a task ranks, about.
RANKED = 1 << 18

TAILS = "row bigint, doc_id bigint, n bigint, heads array<bigint>, before bigint, tail int, tail_crc bigint, ids binary"


def tokenised(docs: DataFrame, vocabulary_path: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """A row a document: its number of ids, the checksum of each whole block, and
    length, checksum and ids (32 bits each) of its tail.  ``row`` is unique and
    names the task (its upper bits), ``before`` counts the task's earlier blocks."""
    vocabulary = shared_vocabulary(docs.sparkSession, vocabulary_path)

    def work(batches):
        from pyspark import TaskContext

        row, before, encoder = TaskContext.get().partitionId() << 40, 0, worker_encoder(vocabulary.value)
        for batch in batches:
            texts, at = plain(batch.column(1)), 0
            for run in pieces(texts, 6 << 20):
                ids, sizes = encoder.encode(run)
                starts = np.cumsum(sizes + 1) - sizes - 1
                out = np.full(len(ids) + len(sizes), end_id, "<u4")
                out[gathered(starts, sizes)] = ids
                raw, n = memoryview(out.tobytes()), sizes + 1
                heads, crcs, tails = [], [], []
                for a, size in zip((4 * starts).tolist(), (4 * n).tolist(), strict=True):
                    cut = a + size // (4 * width) * 4 * width
                    heads.append([zlib.crc32(raw[k : k + 4 * width]) for k in range(a, cut, 4 * width)])
                    crcs.append(zlib.crc32(raw[cut : a + size]))
                    tails.append(bytes(raw[cut : a + size]))
                blocks = n // width
                yield pa.record_batch(
                    [
                        pa.array(row + np.arange(len(run))), batch.column(0).slice(at, len(run)), pa.array(n), pa.array(heads, pa.list_(pa.int64())),
                        pa.array(before + np.cumsum(blocks) - blocks), pa.array(n % width, pa.int32()), pa.array(crcs, pa.int64()), pa.array(tails, pa.binary()),
                    ],
                    names=["row", "doc_id", "n", "heads", "before", "tail", "tail_crc", "ids"],
                )
                row, before, at = row + len(run), before + int(blocks.sum()), at + len(run)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, TAILS)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """(value, counts): the most valuable multiset of ``sizes`` (rising) within ``capacity``."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            own = best[c - sizes[: fit[c]]] + values[: fit[c]]
            k = int(own.argmax())
            if own[k] > best[c]:
                best[c], last[c] = own[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def generated(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): columns of the linear program that covers ``demand`` of
    each size with the fewest sequences, and how often it uses each (fractions)."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes)
    inverse, uses = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for step in range(PIVOTS * m):
        gain, column = knapsack(sizes, inverse.sum(axis=0), capacity)
        if gain <= 1 + 1e-9:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-11, uses / np.where(change > 1e-11, change, 1), np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * change, 0)
        uses[out] = ratio[out]
        patterns[:, out] = column
        if step % 200 == 199:  # rounding errors add up
            inverse = np.linalg.inv(patterns)
            continue
        inverse[out] /= change[out]
        change[out] = 0
        inverse -= np.outer(change, inverse[out])
    return patterns.T, uses


def rounded(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times): patterns that hold exactly ``demand`` of each size, and
    how often each is used: the linear program's, rounded down, and for what is
    left sequences of the longest that fit."""
    patterns, uses = generated(sizes, demand.astype(float), capacity)
    left, chosen, times = demand.copy(), [], []
    for k in np.argsort(-uses, kind="stable").tolist():
        inside = patterns[k] > 0
        t = min(int(uses[k] + 1e-6), int((left[inside] // patterns[k][inside]).min()))
        if t > 0:
            chosen.append(patterns[k])
            times.append(t)
            left = left - t * patterns[k]
    while left.any():
        own, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(left)[::-1].tolist():
            own[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(own[k] * sizes[k])
        t = int((left[own > 0] // own[own > 0]).min())
        chosen.append(own)
        times.append(t)
        left = left - t * own
    return np.array(chosen, np.int64).reshape(-1, len(sizes)), np.array(times, np.int64)


@dataclass
class Plan:
    """aside: slices whose tails fill gaps; sequences: of patterns; spare: ids of
    the stream beyond all gaps; spans[u]: for the tails of u units, the first rank
    of each pattern's share, how many a use takes, and its first sequence."""

    aside: int = SLICES
    sequences: int = 0
    spare: int = 0
    first: dict[int, int] = field(default_factory=dict)
    spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def planned(units: np.ndarray, slices: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int = WIDTH) -> Plan:
    """The plan for a histogram: so many tails (counts) with so many ids by units and slice."""
    capacity, total, aside = width // GRAIN, int(ids.sum()), 1
    while True:
        packed = slices >= aside
        if not packed.any():
            return Plan(spare=total)
        sizes, where = np.unique(units[packed], return_inverse=True)
        demand = np.zeros(len(sizes), np.int64)
        np.add.at(demand, where, counts[packed])
        patterns, times = rounded(sizes, demand, capacity)
        sequences, held = int(times.sum()), int(ids[packed].sum())
        gaps = sequences * width - held
        if gaps <= total - held:
            break
        # the gaps' share of the packed ids says how much to set aside at least
        aside = min(SLICES, max(aside + 1, int(SLICES * gaps / (held + gaps))))
    plan = Plan(aside, sequences, total - held - gaps)
    bases = np.cumsum(times) - times
    ahead = np.cumsum(demand) - demand
    for k, u in enumerate(sizes.tolist()):
        own = np.flatnonzero(patterns[:, k])
        taken = times[own] * patterns[own, k]
        plan.first[u] = int(ahead[k])
        plan.spans[u] = (np.cumsum(taken) - taken, patterns[own, k], bases[own])
    return plan


def running(rows: DataFrame, keys: list[str], size: Column, many: int) -> DataFrame:
    """``rows`` with ``ahead``: the sum of ``size`` over all earlier rows by ``keys``.

    Ranges of keys are dealt to tasks, about RANKED of the ``many`` rows each;
    the driver adds up one total a range."""
    spark = rows.sparkSession
    parts = max(1, -(-many // RANKED))
    ordered = rows.withColumn("__size", size.cast("long")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def work(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            inner = total + np.cumsum(own) - own
            total += int(own.sum())
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(own), part)), pa.array(inner)], names=[*batch.schema.names, "__part", "__inner"])

    kinds = [f"`{n}` {k}" for n, k in [*ordered.dtypes, ("__part", "bigint"), ("__inner", "bigint")]]
    table = written(ordered.mapInArrow(work, ", ".join(kinds)), "running")
    totals = sorted(map(tuple, table.groupBy("__part").agg(F.sum("__size")).collect()))
    bases = np.cumsum([0, *(t for _, t in totals)]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "__part bigint, __base bigint")
    # one row a range: bounded by the number of ranges
    return table.join(F.broadcast(base), "__part").withColumn("ahead", F.col("__base") + F.col("__inner")).drop("__part", "__inner", "__base", "__size")


def sequence_of(units: Column, rank: Column, plan: Plan) -> Column:
    """bigint: the sequence of the tail of that rank among those of as many units."""

    @F.arrow_udf("bigint")
    def run(units: pa.Array, rank: pa.Array) -> pa.Array:
        u, r = units.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        out = np.zeros(len(u), np.int64)
        for k in np.unique(u).tolist():
            own = np.flatnonzero(u == k)
            first, each, base = plan.spans[k]
            at = r[own] - plan.first[k]
            j = np.searchsorted(first, at, side="right") - 1
            out[own] = base[j] + (at - first[j]) // each[j]
        return pa.array(out)

    return run(units, rank)


def checksums(ids: Column, cuts: Column) -> Column:
    """array<bigint>: the CRC-32 of each cut (start, length) of 32-bit ids."""

    @F.arrow_udf("array<bigint>")
    def run(ids: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for raw, own in zip(ids, cuts.to_pylist(), strict=True):
            raw = memoryview(raw.as_buffer())
            out.append([zlib.crc32(raw[4 * x["start"] : 4 * (x["start"] + x["length"])]) for x in own])
        return pa.array(out, pa.list_(pa.int64()))

    return run(ids, cuts)


def poured(stream: DataFrame, slots: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, start, length, seq, offset: the overlaps of the tails of ``stream``
    (row, ahead, tail) with ``slots`` (seq, at, ahead, room), both runs of whole
    numbers; none is longer than ``width``, so each lies in two buckets at most."""
    reach = lambda size: F.explode(F.sequence(F.floor(F.col("ahead") / width), F.floor((F.col("ahead") + size - 1) / width))).alias("bucket")
    tails = stream.select("row", F.col("ahead").alias("a"), "tail", reach(F.col("tail")))
    gaps = slots.select("seq", "at", F.col("ahead").alias("b"), "room", reach(F.col("room")))
    low, high = F.greatest("a", "b"), F.least(F.col("a") + F.col("tail"), F.col("b") + F.col("room"))
    both = tails.join(gaps, "bucket").where(low < high).where(F.floor(low / width) == F.col("bucket"))
    return both.select("row", (low - F.col("a")).alias("start"), (high - low).alias("length"), "seq", (F.col("at") + low - F.col("b")).alias("offset"))


def spare_slots(spark: SparkSession, first: int, ahead: int, spare: int, width: int = WIDTH) -> DataFrame:
    """seq, at, ahead, room: whole sequences, then powers of two, for ``spare`` ids."""
    whole, rest = divmod(spare, width)
    out = spark.range(whole).select((F.col("id") + first).alias("seq"), F.lit(0).cast("long").alias("at"), (F.col("id") * width + ahead).alias("ahead"), F.lit(width).cast("long").alias("room"))
    rows, at = [], ahead + whole * width
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            rows.append((first + whole + len(rows), 0, at, 1 << k))
            at += 1 << k
    return out.unionByName(spark.createDataFrame(rows, "seq bigint, at bigint, ahead bigint, room bigint")) if rows else out


def packed(docs: DataFrame, vocabulary_path: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    unit, place = F.ceil(F.col("tail") / GRAIN).cast("long"), F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("long")
    table = written(tokenised(docs, vocabulary_path, end_id, text_col, id_col, width), "tails")
    tasks = table.groupBy(F.shiftright("row", 40).alias("task")).agg(F.sum(F.size("heads")).alias("blocks")).orderBy("task").collect()
    bases = np.cumsum([0, *(r["blocks"] for r in tasks)]).tolist()
    base = spark.createDataFrame([(r["task"], b) for r, b in zip(tasks, bases, strict=False)], "task bigint, base bigint")
    blocks = table.select("doc_id", "n", F.shiftright("row", 40).alias("task"), "before", F.posexplode("heads").alias("k", "ids_crc32")).join(F.broadcast(base), "task")  # a row a task
    out = blocks.select("doc_id", (F.col("k") * width).cast("long").alias("start"), F.lit(width).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("base") + F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = table.where("tail > 0").withColumns({"units": unit, "slice": place})
    histogram = np.array([tuple(r) for r in tails.groupBy("units", "slice").agg(F.count("*"), F.sum("tail")).orderBy("units", "slice").collect()], np.int64).reshape(-1, 4)
    if not len(histogram):
        return out
    plan = planned(*histogram.T, width)
    many, aside = int(histogram[:, 2].sum()), int(histogram[histogram[:, 1] < plan.aside, 2].sum())
    tail_start = (F.col("n") - F.col("tail")).alias("start")

    ranked = running(tails.where(F.col("slice") >= plan.aside).select("row", "doc_id", "n", "tail", "tail_crc", "units"), ["units", "row"], F.lit(1), many)
    placed = ranked.withColumn("seq", sequence_of(F.col("units"), F.col("ahead"), plan)).drop("ahead")
    # the tails of a sequence are width / GRAIN at most
    within: Callable[[Column], Column] = lambda c: F.aggregate(F.col("own"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["row"] < c, x["tail"]).otherwise(0))
    sequences = written(placed.groupBy("seq").agg(F.collect_list(F.struct("row", "doc_id", "n", "tail", "tail_crc")).alias("own")), "sequences")
    each = sequences.select("seq", "own", F.explode("own").alias("x"))
    whole = each.select("seq", within(F.col("x.row")).alias("offset"), "x.*")
    out = out.unionByName(whole.select("doc_id", tail_start, F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("seq") + bases[-1]).alias("sequence_id"), "offset"))

    used = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["tail"])
    gaps = sequences.select("seq", used.alias("at"), (width - used).alias("room")).where("room > 0")
    slots = running(gaps, ["seq"], F.col("room"), plan.sequences)
    stream = running(tails.where(F.col("slice") < plan.aside).select("row", "tail"), ["row"], F.col("tail"), aside)
    filled = int(histogram[histogram[:, 1] < plan.aside, 3].sum()) - plan.spare
    cuts = poured(stream, slots.unionByName(spare_slots(spark, plan.sequences, filled, plan.spare, width)), width)
    own = cuts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "seq", "offset")).alias("cuts"))  # WIDTH at most
    both = own.join(table.where("tail > 0").where(place < plan.aside).select("row", "doc_id", "n", "tail", "ids"), "row")
    parts = both.select("doc_id", "n", "tail", F.explode(F.arrays_zip("cuts", checksums(F.col("ids"), F.col("cuts")).alias("crc"))).alias("x"))
    return out.unionByName(parts.select("doc_id", (F.col("n") - F.col("tail") + F.col("x.cuts.start")).alias("start"), F.col("x.cuts.length").alias("length"), F.col("x.crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("x.cuts.seq") + bases[-1]).alias("sequence_id"), F.col("x.cuts.offset").alias("offset")))
