"""Near-duplicates by five-word shingles at a Jaccard similarity of 0.8 or more.

The fingerprints of :mod:`simhash` find the candidates, texts decide.  A
fingerprint here has 512 bits, from the distinct shingles of a text; at a
similarity of 0.8 two of them differ in 15 % of their bits, too many for the
pigeonhole principle alone to stay selective.  So links come in two steps:

1. The first 64 bits link at three or fewer differing bits by the generalised
   pigeonhole search (:func:`simhash.rooted`), whole for groups of any size.
   These are tight groups of nearly equal texts.
2. Partitions of the 512 bits, each probed by equality, bring together texts of
   different tight groups.  A pair at the similarity agrees in one partition at
   least with a probability of 1 - MISS: the width of partitions follows the
   logarithm of the number of texts, their number follows the width.  Pairs
   that agree and differ in at most FAR of 128 bits are candidates.  A forest of
   the candidates under each value joins tight groups to clusters: first under
   few partitions, then under the others, where a cluster counts as one already.
3. A cluster's rows meet with the hashes of their shingles, each row once.  Of
   all pairs of different tight groups that differ in at most FAR of 128 bits,
   those with a Jaccard similarity of LEAST or more are links.  Pairs that other
   links join already are left out, all others are tried; only links that join
   something come out.  Clusters of more than BLOCK bytes are dealt into blocks:
   each is tried alone, then every two of them, but for two of one group.

In steps 2 and 3 rows are first compared with the centre of a group.  A row
further away than FAR and the group's radius has no candidate in it, so large
groups cost rows that lie elsewhere one comparison, not one for every member.

Edge cases: a null text is the empty text; texts without words are equal to
one another; texts of fewer than five words have one shingle, the whole text;
rows with a null id take no part and stay; rows of equal ids are judged each by
its own text; an empty table gives an empty table; extra columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .scratch import written
from .textbatch import in_pieces

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Words of 64 bits a fingerprint.
WORDS = 8
#: Share of bits in which fingerprints of texts at LEAST differ: the angle of
#: two sets of equal size, whose cosine is 2 J / (1 + J).
DIFFER = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
#: Probability that no partition brings a pair at LEAST together.
MISS = 0.01
#: Texts that share a partition's value by chance, on average.
CROWD = 64
#: Of 128 bits: candidates differ in at most FAR (19 are expected at LEAST,
#: 64 by chance).
FAR = 32
#: Partitions under which clusters begin.
FEW = 3
#: Bytes of the hashes that a block holds, about; a longer text is a block of its own.
BLOCK = 8 << 20


def shingles(text: bytes) -> set[int]:
    """XXH64 of the distinct word shingles; all words are one if they are fewer."""
    parts = text.lower().split()
    if not parts:
        return set()
    digest = xxhash.xxh64_intdigest
    return {digest(b" ".join(parts[i : i + SHINGLE]), SEED) for i in range(max(1, len(parts) - SHINGLE + 1))}


def wide(texts: pa.Array) -> np.ndarray:
    """uint64, WORDS columns: the fingerprint of each text."""
    own = [shingles(x) for x in pc.cast(texts, pa.large_binary()).to_pylist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    hashes = np.fromiter((h for x in own for h in x), np.uint64, int(sizes.sum()))
    out = np.zeros((len(own), WORDS), np.uint64)
    for k in range(WORDS):
        # other bits of the same hash: multiplied and folded twice
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        out[:, k] = simhash.majority(mixed ^ (mixed >> np.uint64(31)), sizes)
    return out


def fingerprint(text: Column) -> Column:
    """array<bigint>: the fingerprint's words as signed numbers."""
    kind = pa.list_(pa.int64())

    @F.arrow_udf("array<bigint>")
    def run(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda x: pa.FixedSizeListArray.from_arrays(pa.array(wide(x).view(np.int64).reshape(-1)), WORDS).cast(kind), kind)

    return run(text)


def partitions(n: int) -> np.ndarray:
    """Bits of each partition, a row each, for ``n`` texts: seeded draws."""
    width = min(40, max(8, round(math.log2(max(n, 1) / CROWD))))
    many = math.ceil(math.log(1 / MISS) / (1 - DIFFER) ** width)
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(64 * WORDS, width, replace=False) for _ in range(many)])


def probes(words: Column, bits: np.ndarray) -> Column:
    """array<bigint>: a fingerprint's value in each partition, with its number."""
    count, width = bits.shape
    weights = 1 << np.arange(width, dtype=np.int64)

    @F.arrow_udf("array<bigint>")
    def run(words: pa.Array) -> pa.Array:
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for at in range(0, len(words), 4096):
            some = np.ascontiguousarray(flat[at * WORDS : (at + 4096) * WORDS]).view(np.uint8).reshape(-1, 8 * WORDS)
            own = np.unpackbits(some, axis=1, bitorder="little")
            out.append(np.stack([(own[:, x].astype(np.int64) @ weights) * count + i for i, x in enumerate(bits)], axis=1))
        values = np.concatenate(out).reshape(-1) if out else np.zeros(0, np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(values), count).cast(pa.list_(pa.int64()))

    return run(words)


def candidates(nodes: DataFrame, bits: np.ndarray) -> DataFrame:
    """a, b: a forest of the candidates under each value, as pairs of the groups
    (root) of ``nodes`` (w, root)."""
    rows = nodes.select(F.explode(probes(F.col("w"), bits)).alias("k"), "root", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "root")
    return dealt.mapInArrow(_met, "a bigint, b bigint")


def _met(batches):
    """Forests of sorted rows (k, root, x, y)."""
    rest = np.zeros((0, 4), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns], axis=1)])
        # the values but the last are whole
        last = np.flatnonzero(rows[:, 0] != rows[-1, 0]) if len(rows) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = rows[cut:]
        yield from _forest(rows[:cut])
    yield from _forest(rest)


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of ``sizes``."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(sizes: np.ndarray, most: int):
    """Slices of ``sizes``, each with a sum of at most ``most`` or a single item."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def _close(rows: np.ndarray, most_pairs: int = 1_000_000):
    """a, b, d: places of all pairs of rows (k, root, x, y) of a value and different
    groups that differ in d of 128 bits, FAR or fewer, some at a time, by a."""
    if len(rows) < 2:
        return
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(head, len(rows)))
    first = np.flatnonzero(np.append(True, rows[head[1:], 0] != rows[head[:-1], 0]))  # groups that begin a value
    after = np.repeat(np.append(first[1:], len(head)), np.diff(np.append(first, len(head)))) - np.arange(len(head)) - 1
    xy = np.ascontiguousarray(rows[:, 2:4]).view(np.uint64)
    # the centre of a group has the majority of its bits
    centre, large = xy[head], np.flatnonzero(size > 1)
    for k in _runs(size[large], most_pairs // 16):
        own = large[k]
        n = size[own]
        bits = np.unpackbits(xy[np.repeat(head[own], n) + _inside(n)].view(np.uint8), axis=1, bitorder="little")
        most = 2 * np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64) > n[:, None]
        centre[own] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)
    differ = lambda p, q: np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    reach = FAR + np.maximum.reduceat(differ(xy, centre[group]), head)
    for k in _runs(after[group], most_pairs):
        n = after[group[k]]
        a = np.repeat(np.arange(k.start, k.stop), n)
        g = group[a] + 1 + _inside(n)
        near = differ(xy[a], centre[g]) <= reach[g]
        a, g = a[near], g[near]
        for m in _runs(size[g], most_pairs):
            n = size[g[m]]
            p, q = np.repeat(a[m], n), np.repeat(head[g[m]], n) + _inside(n)
            d = differ(xy[p], xy[q])
            near = d <= FAR
            if near.any():
                yield p[near], q[near], d[near]


def _forest(rows: np.ndarray):
    """A forest of the candidates between the groups of each value."""
    if not len(rows):
        return
    # the rows of a group are joined from the start
    _, first, same = np.unique(rows[:, :2], axis=0, return_index=True, return_inverse=True)
    up, kept = first[same.reshape(-1)], []
    for p, q, _ in _close(rows):
        while len(p):  # a pair for every two trees that meet
            low, high = np.minimum(up[p], up[q]), np.maximum(up[p], up[q])
            apart = low != high
            p, q, low, high = p[apart], q[apart], low[apart], high[apart]
            if not len(p):
                break
            _, one = np.unique(high, return_index=True)  # each tree is hung under one other
            kept.append(np.stack([rows[p[one], 1], rows[q[one], 1]]))
            up[high[one]] = low[one]
            while (up[up] != up).any():
                up = up[up]
    if kept:
        a, b = np.concatenate(kept, axis=1)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def hashes(text: Column) -> Column:
    """binary: the shingles of a text, 8 bytes each."""

    def hashed(texts: pa.Array) -> pa.Array:
        own = (shingles(x) for x in pc.cast(texts, pa.large_binary()).to_pylist())
        return pa.array([np.fromiter(x, np.uint64, len(x)).tobytes() for x in own], pa.binary())

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        return in_pieces(text, hashed, pa.binary())

    return run(text)


def _tried(batches):
    """Links of sorted rows (k, root, x, y, side, s): pairs of groups under each k."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        k = batch.column(0).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        rest = batch.slice(cut)
        yield from _similar(batch.slice(0, cut))
    if rest is not None:
        yield from _similar(rest)


def _similar(batch: pa.RecordBatch):
    """A forest of the links between the groups of each k: all candidates are
    tried, from different sides unless the side is -1, that it leaves apart."""
    if batch.num_rows < 2:
        return
    rows = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
    side, sets = batch.column(4).to_numpy(), batch.column(5)
    count = pc.binary_length(sets).to_numpy() // 8
    start = np.cumsum(count) - count
    _, ids = np.unique(np.frombuffer(b"".join(sets.to_pylist()), np.uint64), return_inverse=True)
    own = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    group = np.cumsum(np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    top, kept = np.arange(int(group[-1]) + 1), []
    for a, b, _ in _close(rows):
        # sets of too different sizes can't be similar
        fit = ((side[a] < 0) | (side[a] != side[b])) & (np.minimum(count[a], count[b]) >= LEAST * np.maximum(count[a], count[b]) * (1 - 1e-9))
        a, b = a[fit], b[fit]
        cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)]), len(a)).tolist()
        for at, stop in zip(cuts[:-1], cuts[1:], strict=True):
            one = int(a[at])
            others = b[at:stop]
            others = others[top[group[others]] != top[group[one]]]
            if not len(others):
                continue
            if count[one]:
                mine, n = ids[start[one] : start[one] + count[one]], count[others]
                own[mine] = True
                both = np.add.reduceat(own[ids[np.repeat(start[others], n) + _inside(n)]], np.cumsum(n) - n, dtype=np.int64)
                own[mine] = False
                others = others[both / (count[one] + n - both) >= LEAST]
            for other in others.tolist():
                low, high = sorted((int(top[group[one]]), int(top[group[other]])))
                if low != high:
                    kept.append((rows[one, 1], rows[other, 1]))
                    top[top == high] = low
    if kept:
        p, q = np.array(kept, np.int64).T
        yield pa.record_batch([pa.array(p), pa.array(q)], names=["a", "b"])


def _blocks(own: DataFrame) -> DataFrame:
    """``own`` (r, cluster, root, s, ...) with ``owner`` and ``i``, the block in its
    cluster: groups of more than BLOCK bytes own theirs, the others share some."""
    size = own.groupBy("cluster", "root").agg(F.sum(F.octet_length("s") + F.lit(64)).alias("n"))
    shared = size.where(F.col("n") <= BLOCK).groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("many"))
    sized = own.join(size.hint("merge"), ["cluster", "root"]).join(shared.hint("merge"), "cluster", "left")
    large = F.col("n") > BLOCK
    i = F.when(large, F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.col("many")))
    return sized.select(*own.columns, F.when(large, F.col("root")).alias("owner"), i.alias("i"))


def _links(rows: DataFrame) -> DataFrame:
    """a, b: links between groups of ``rows`` (k, root, x, y, side, s)."""
    dealt = rows.select("k", "root", "x", "y", "side", "s").repartition("k").sortWithinPartitions("k", "root")
    return written(dealt.mapInArrow(_tried, "a bigint, b bigint"), "links")


def verified(own: DataFrame) -> DataFrame:
    """a, b: links that join the groups (root) of ``own`` (r, cluster, root, x, y, s)
    as all links between rows of a cluster do."""
    placed = written(_blocks(own), "blocks")
    links = _links(placed.where("owner IS NULL").select("*", F.xxhash64("cluster", "i").alias("k"), F.lit(-1).alias("side")))
    parts = placed.select("cluster", "owner", "i").distinct().groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    many = written(parts.select("cluster"), "large-clusters")
    if many.isEmpty():
        return links
    # groups that are joined by now are one; its blocks don't meet one another
    rest = relabelled(own.join(many.hint("merge"), "cluster", "left_semi"), components(links))
    placed = written(_blocks(rest), "blocks")
    block = placed.select("cluster", F.struct("owner", "i").alias("p")).distinct()
    pairs = block.join(block.withColumnRenamed("p", "q"), "cluster").where("p < q AND (p.owner IS NULL OR q.owner IS NULL OR p.owner <> q.owner) OR p = q AND p.owner IS NULL")
    pairs = pairs.select("cluster", "p", "q", F.xxhash64("cluster", "p.owner", "p.i", "q.owner", "q.i").alias("k"))
    # a block of pairs is two blocks' rows, or one's
    sides = pairs.select("cluster", F.col("p").alias("b"), "k", F.when(F.expr("p = q"), -1).otherwise(0).alias("side")).unionByName(
        pairs.where("p <> q").select("cluster", F.col("q").alias("b"), "k", F.lit(1).alias("side"))
    )
    sides = written(sides.select("cluster", F.col("b.owner").alias("o"), F.col("b.i").alias("j"), "k", "side"), "block-pairs")
    met = placed.withColumnRenamed("cluster", "c").join(sides.hint("merge"), F.expr("c = cluster AND i = j AND owner <=> o"))
    return links.unionByName(_links(met))


def relabelled(rows: DataFrame, group: DataFrame, into: str = "root") -> DataFrame:
    """``rows`` with ``into``, the root of ``group`` (node, root) that their own root has."""
    own = group.select(F.col("node").alias("root"), F.col("root").alias("reached"))
    joined = rows.join(own.hint("merge"), "root", "left")
    if into == "root":
        return joined.withColumn("root", F.coalesce("reached", "root")).drop("reached")
    return joined.withColumnRenamed("reached", into)


def linked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the smallest tight group that links reach, for every tight
    group with a link to another; ``rows`` (r, text) hold the texts."""
    bits = partitions(nodes.count())
    first = written(candidates(nodes.select("w", "root"), bits[:FEW]), "first-forest")
    begun = relabelled(nodes.select("w", "root"), components(first))
    forest = first.unionByName(written(candidates(begun, bits[FEW:]), "forest"))
    # rows of groups without candidates end here
    clusters = written(components(forest), "clusters")
    taking = relabelled(nodes.select("r", "root", F.col("w")[0].alias("x"), F.col("w")[1].alias("y")), clusters, "cluster").where("cluster IS NOT NULL")
    own = rows.join(written(taking, "taking").hint("merge"), "r").select("r", "cluster", "root", "x", "y", hashes(F.col("text")).alias("s"))
    return components(verified(written(own, "sets")))


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each group, that with the smallest id."""
    known = docs.agg(F.count(id_col).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if known["n"] == known["d"]:
        rows, row = docs, F.col(id_col).cast("long")
    else:  # equal ids: rows get numbers of their own, fixed in a table
        rows, row = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), F.col("__row")
    taking = rows.where(F.col(id_col).isNotNull())
    own = written(taking.select(row.alias("r"), F.col(id_col).cast("long").alias("i"), fingerprint(F.col(text_col)).alias("w")), "wide-prints")
    # texts of equal fingerprints are one node, that of the smallest id
    nodes = written(own.groupBy("w").agg(F.min(F.struct("i", "r")).alias("k")).select("k.i", "k.r", "w", F.col("w")[0].alias("f")), "wide-nodes")
    roots = written(simhash.rooted(nodes.select("f")), "tight-groups")
    nodes = written(nodes.join(roots.hint("merge"), "f").select("i", "r", "w", "root"), "nodes")
    reach = linked(taking.select(row.alias("r"), F.col(text_col).alias("text")), nodes).select(F.col("node").alias("root"), F.col("root").alias("reached"))
    whole = nodes.select("i", "r", "root").join(written(reach, "reached").hint("merge"), "root", "left")
    keep = written(whole.groupBy(F.coalesce("reached", "root").alias("g")).agg(F.min(F.struct("i", "r")).alias("k")).select(F.col("k.r").alias("__keep")), "kept")
    # ids kept grow with the corpus: they are sent by id, never broadcast
    return rows.join(keep.hint("merge"), row == F.col("__keep"), "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
