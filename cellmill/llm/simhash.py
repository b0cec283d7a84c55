"""SimHash fingerprints and near-duplicates within a few differing bits.

Fingerprints of 64 bits link at TAU or fewer differing bits.  Search follows
the general pigeonhole principle: if the bits are dealt into m partitions with
thresholds that sum to TAU - m + 1, two linked fingerprints differ in at most
the threshold's bits in some partition.  Bits that go together are dealt to
one partition; a dynamic program allots the thresholds, unequal ones too, that
cost the fewest signatures and estimated candidates, for several m.  A
partition with threshold t is probed by its values with t of its bits masked
out.  Every probe is verified.

A signature is a mask of bits and the fingerprint under the mask.  Where many
fingerprints share a signature, the principle is applied again to the bits
outside the mask, until the groups are small; nothing is capped.  Groups give
a spanning forest of their links rather than all pairs.

Edge cases: a null text is the empty text, whose fingerprint is zero; equal
texts have equal fingerprints and are one node of the graph; rows with a null
id get the smallest id of their group (null if it has none); repeated rows
each get their result; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written
from .textbatch import in_pieces

BITS, TAU, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one signature that are compared with one another; larger
#: groups are divided by further bits first.
GROUP = 2048
#: With so few bits outside a mask, a group has few members (2 ** FEW) and is
#: compared as it is.
FEW = 11
#: What a signature costs (a row through a shuffle and a sort) against a
#: candidate pair (an exclusive or and a count of bits in numpy).
SIGNATURE_COST = 100
#: Partition counts that the dynamic program chooses from, and the largest
#: threshold of a partition.
PARTITIONS, MOST_MASKED = (2, 3, 4), 2

# each byte's bits as eight counters of a byte
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 a text, from the XXH64 of its word shingles, repeats included."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(pc.cast(texts, pa.large_binary()).to_pylist()):
        parts = text.lower().split()
        if not parts:
            continue
        line = b" ".join(parts)
        if len(parts) <= shingle:
            hashes.append(digest(line, seed))
            sizes[i] = 1
            continue
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: 1 - shingle].tolist()
        hashes += [digest(line[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)]
        sizes[i] = len(start)
    return majority(np.array(hashes, np.uint64), sizes)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """uint64 a text: the bits set in over half of its own ``hashes``, which
    lie text after text, ``sizes[i]`` of them for text i; zero for none."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    first = np.cumsum(sizes[full]) - sizes[full]
    runs = -(-sizes[full] // 255)  # a counter of a byte holds 255 shingles
    owner = np.repeat(np.arange(len(full)), runs)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    sums = np.add.reduceat(spread, first[owner] + 255 * step, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(len(owner), 64).astype(np.int64), np.cumsum(runs) - runs, axis=0)
    bits = 2 * counts > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """bigint: the fingerprint of each text, its 64 bits as a signed number."""

    @F.arrow_udf("bigint")
    def run(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda x: pa.array(fingerprints(x, shingle, seed).view(np.int64)), pa.int64())

    return run(text)


def together(prints: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints (column f) two bits are both set.
    Tasks send sums, so the driver gets 64 rows a task at most."""

    def work(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(BITS)), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["i", "row"])

    sums = prints.select("f").mapInArrow(work, "i bigint, row array<bigint>").select("i", F.posexplode("row").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for r in sums.collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def dealt(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m partitions of equal size: each takes the bit that goes
    best with those it has, so that correlated bits lie together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    free, out = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [free.pop(int(np.argmax(near[np.ix_(free, free)].sum(axis=1))))]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(near[np.ix_(free, own)].sum(axis=1)))))
        out.append(sorted(own))
    return out


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    """The bits as a signed 64-bit number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def chances(p: np.ndarray, most: int) -> np.ndarray:
    """Probability that two independent fingerprints differ in 0, 1 ... ``most`` of bits with these shares."""
    differ = 2 * p * (1 - p)
    out = np.zeros(most + 1)
    out[0] = 1
    for d in differ:
        out[1:] = out[1:] * (1 - d) + out[:-1] * d
        out[0] *= 1 - d
    return out


def allotted(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 (a partition with -1 isn't probed) that sum to
    ``total`` at the lowest cost; costs[i][t + 1] is that of partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, more in enumerate(options):
                key, value = spent + k - 1, (cost + more, [*chosen, k - 1])
                if key not in after or value[0] < after[key][0]:
                    after[key] = value
        best = after
    return best.get(total, (math.inf, []))


def masks(prints: DataFrame, tau: int = TAU) -> tuple[list[int], list[int]]:
    """(masks, order): the masks of the cheapest signatures for the distinct
    fingerprints ``prints`` (column f), and the bits with correlated ones
    next to each other."""
    both, n = together(prints), prints.count()
    p = np.diag(both) / max(n, 1)
    plans = {m: dealt(both, n, m) for m in PARTITIONS if m <= tau + 1}
    parts = [(m, i, bits) for m, plan in plans.items() for i, bits in enumerate(plan)]
    whole = F.array(*(F.struct(F.lit(k).alias("k"), F.col("f").bitwiseAND(F.lit(mask_of(bits))).alias("v")) for k, (_, _, bits) in enumerate(parts)))
    equal = prints.select(F.explode(whole).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
    pairs = {r["k"]: r["s"] for r in equal.groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1.0) / 2).alias("s")).collect()}
    choice: tuple[float, list[int]] = (math.inf, [])
    for m, plan in plans.items():
        costs = []
        for k, (_, _, bits) in enumerate(parts):
            if parts[k][0] == m:
                chance = chances(p[bits], MOST_MASKED)
                many = [pairs.get(k, 0.0) * float(chance[: t + 1].sum() / max(chance[0], 1e-30)) for t in range(MOST_MASKED + 1)]
                costs.append([0.0] + [SIGNATURE_COST * n * math.comb(len(bits), t) + many[t] for t in range(MOST_MASKED + 1)])
        cost, thresholds = allotted(costs, tau - m + 1)
        if cost < choice[0]:
            some = [mask_of(set(bits) - set(out)) for bits, t in zip(plan, thresholds, strict=True) if t >= 0 for out in combinations(bits, t)]
            choice = (cost, some)
    return choice[1], [b for part in plans[max(plans)] for b in part]


def divided(mask: int, order: list[int], tau: int) -> list[int]:
    """Masks that hold ``mask`` and one of tau + 1 parts of the other bits."""
    rest = [b for b in order if not (mask >> b) & 1]
    own = [b for b in range(BITS) if (mask >> b) & 1]
    return [mask_of(own + part.tolist()) for part in np.array_split(np.array(rest), tau + 1)]


def links(prints: DataFrame, tau: int = TAU, group: int = GROUP) -> DataFrame:
    """a, b: links that join all fingerprints (column f, distinct) that chains
    of at most ``tau`` differing bits connect."""
    wanted, order = masks(prints, tau)
    signed = lambda df, some: df.select("f", F.explode(F.array(*map(F.lit, some))).alias("k")).withColumn("v", F.col("f").bitwiseAND(F.col("k")))
    table, out = written(signed(prints, wanted), "signatures"), None
    while True:
        sizes = table.groupBy("k", "v").agg(F.count("*").alias("c")).where("c > 1")
        sizes = written(sizes, "groups")
        fits = (F.col("c") <= group) | (F.bit_count("k") >= BITS - FEW)
        small = table.join(sizes.where(fits).select("k", "v"), ["k", "v"])
        found = small.select("k", "v", "f").repartition("k", "v").sortWithinPartitions("k", "v").mapInArrow(lambda x: linked(x, tau), "a bigint, b bigint")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(~fits)
        ask = [r["k"] for r in large.select("k").distinct().collect()]
        if not ask:
            return out
        finer = [(k, x) for k in ask for x in divided(k, order, tau)]
        steps = prints.sparkSession.createDataFrame(finer, "k bigint, deeper bigint")
        hot = table.join(large.select("k", "v"), ["k", "v"]).join(F.broadcast(steps), "k")
        table = written(hot.select("f", F.col("deeper").alias("k"), F.col("f").bitwiseAND(F.col("deeper")).alias("v")).distinct(), "signatures")


def linked(batches, tau: int):
    """Verified links in sorted runs of equal (k, v): a forest for each batch."""
    rest = np.zeros((0, 3), np.int64)
    for batch in batches:
        rows = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns], axis=1)
        rows = np.concatenate([rest, rows])
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = rows[cut:]
        yield from _forest(rows[:cut], tau)
    yield from _forest(rest, tau)


def _forest(rows: np.ndarray, tau: int, most_pairs: int = 1_000_000):
    if len(rows) < 2:
        return
    head = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    size = np.diff(np.append(head, len(rows)))
    f = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
    # each row is compared with those after it in its group, some million pairs at a time
    after = np.repeat(head + size, size) - np.arange(len(rows)) - 1
    ends = np.cumsum(after)
    root, at = np.arange(len(rows)), 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_pairs)))
        n = after[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(f[a] ^ f[b]) <= tau
        a, b, at = a[near], b[near], stop
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            open_ = low != high
            a, b = a[open_], b[open_]
            np.minimum.at(root, high[open_], low[open_])
            while (root[root] != root).any():
                root = root[root]
    own = np.flatnonzero(root != np.arange(len(rows)))
    if len(own):
        pairs = np.unique(np.stack([f[own], f[root[own]]], axis=1), axis=0).view(np.int64)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def rooted(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """f, root: for each distinct fingerprint of ``prints`` (column f) the
    smallest one that links reach."""
    nodes = written(prints.select("f").distinct(), "nodes")
    roots = written(components(links(nodes, tau)), "roots").withColumnRenamed("node", "f")
    return nodes.join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("root"))


def grouped(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest id that links reach, for every row."""
    own = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("f")), "fingerprints")
    roots = written(rooted(own, tau), "members")
    least = own.groupBy("f").agg(F.min("doc_id").alias("least")).join(roots, "f").groupBy("root").agg(F.min("least").alias("component_id"))
    out = own.join(written(roots.join(least, "root").select("f", "component_id"), "labels"), "f")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tau: int = TAU) -> DataFrame:
    """One row of ``docs`` of each group, that with the smallest id; rows with a
    null id take no part and stay.  Rows of an equal id are rows of their own:
    each stays or goes with its own text's group."""
    known = docs.agg(F.count(id_col).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if known["n"] == known["d"]:
        rows, row = docs, F.col(id_col).cast("long")
    else:  # equal ids: rows get numbers of their own, fixed in a table
        rows, row = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), F.col("__row")
    own = rows.where(F.col(id_col).isNotNull()).select(row.alias("r"), F.col(id_col).cast("long").alias("i"), fingerprint(F.col(text_col)).alias("f"))
    own = written(own, "fingerprints")
    first = own.groupBy("f").agg(F.min(F.struct("i", "r")).alias("k")).join(rooted(own, tau), "f").groupBy("root").agg(F.min("k").alias("k"))
    keep = written(first.select(F.col("k.r").alias("__keep")), "kept")
    # ids kept grow with the corpus: they are sent by id, never broadcast
    return rows.join(keep.hint("merge"), row == F.col("__keep"), "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
