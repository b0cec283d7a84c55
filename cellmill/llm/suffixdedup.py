"""Removal of long strings that occur more than once, by suffix arrays.

A string of LENGTH bytes is judged at every place where it starts.  Equal
strings choose the same anchor: of the GRAM-byte grams inside, the leftmost of
the smallest hash.  So equal strings lie in regions (all strings in a row with
one anchor, 336 bytes at most) whose anchors have the same hash.

1. Tasks list the regions of their texts: hash of the anchor, hash of the
   region, place.  Anchors whose hash occurs once are done with.
2. Regions equal as a whole repeat as a whole; counting finds them.  One of
   each joins the suffix arrays, beside the regions that occur once.
3. Regions of one anchor hash meet in a task.  Two-stage sorting orders the
   suffixes of a batch of them: those smaller than their successors are sorted
   directly, scans of the buckets of first bytes induce the others.  Strings
   whose suffix has LENGTH bytes in common with a neighbour's occur again.
4. An anchor with very many different regions is refined first.  Equal strings
   start equally far before their anchor, so regions are divided into blocks of
   starts.  The bytes that all strings of a block share (the core; for a whole
   region that is the anchor's gram) take the anchor's place, and step 2 is
   done again; narrower blocks have longer cores.  A block of one start has the
   string as its core, so that the groups get small and none is ever split.

Edge cases: a null text is the empty text; texts shorter than LENGTH bytes
keep all; rows with equal ids, or null ones, are texts of their own; a text may
have any length, its regions are listed piece by piece; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written
from .textbatch import plain

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1
#: Bytes that a task handles at a time; positions in them take PLACE bits.
PIECE, PLACE = 1 << 20, 24
#: Different regions of one key that meet in one suffix array; more are refined.
TOGETHER = 1024
#: Starts in a block at each step of refinement.
WIDTHS = (35, 9, 3, 1)
#: Bytes of regions in one suffix array, about.
ARRAY = 3 << 19

REGION = "a bigint, r bigint, i bigint, lo int, n int"
_POWERS: list[np.ndarray] = []


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, np.uint64)


BYTE = _table(200)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0xD1342543DE82EF95
        _POWERS[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    h, step = BYTE[data], 1
    while step < GRAM:
        h = h[:-step] * ODD + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: np.ndarray) -> np.ndarray:
    """Place of the anchor of the string that starts at each place of ``data``."""
    h = gram_hashes(data)
    low = np.uint64((1 << PLACE) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = len(key)
    full = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    rows = full.reshape(-1, REACH)
    to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(rows, axis=1).ravel()
    count = n - REACH + 1
    return (np.minimum(to_end[:count], from_start[REACH - 1 : n]) & low).astype(np.int64)


def regions(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The regions of the texts data[starts : starts + sizes], each of LENGTH
    bytes or more: a and r (hashes of the anchor and of the region), text (its
    number), lo (first string, from the text's start) and n (strings)."""
    at = anchors(data)
    counts = sizes - LENGTH + 1
    text = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    own = at[place]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.append(first, len(own)))
    lo, anchor, text = place[first], own[first], text[first]
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[: len(data)], out=sums[1:])
    r = (sums[lo + n - 1 + LENGTH] - sums[lo]) * inverse[lo]
    r = (r ^ (r >> np.uint64(31))) * ODD + (n.astype(np.uint64) << np.uint64(16)) + (anchor - lo).astype(np.uint64)
    hashes = gram_hash_at(data, anchor)
    return {"a": hashes.view(np.int64), "r": r.view(np.int64), "text": text, "lo": lo - starts[text], "n": n}


def gram_hash_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each of some places on, unlike that which
    chose them: the smallest of many hashes is no longer spread evenly."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND[data] * power[: len(data)], out=sums[1:])
    h = (sums[places + GRAM] - sums[places]) * inverse[places]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


_SECOND = _table(64)


def _segments(texts: pa.Array):
    """(bytes, text numbers, offsets in their texts, starts, sizes): runs of
    texts, or of parts of long texts that overlap by LENGTH - 1 bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, held = [], 0
    for t in np.flatnonzero(size >= LENGTH).tolist():
        for at in range(0, int(size[t]) - LENGTH + 1, PIECE):
            stop = min(int(size[t]), at + PIECE + LENGTH - 1)
            if held and held + stop - at > 2 * PIECE:
                yield parts
                parts, held = [], 0
            parts.append((t, at, stop))
            held += stop - at
    if parts:
        yield parts


def _listed(batches):
    for batch in batches:
        texts = plain(batch.column(1))
        raw = pc.cast(texts, pa.large_binary())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for parts in _segments(texts):
            data = np.frombuffer(b"".join(raw[t].as_buffer()[a:b].to_pybytes() for t, a, b in parts), np.uint8)
            text, offset, stop = np.array(parts, np.int64).T
            sizes = stop - offset
            found = regions(data, np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch(
                [pa.array(found["a"]), pa.array(found["r"]), pa.array(ids[text[found["text"]]]), pa.array((found["lo"] + offset[found["text"]]).astype(np.int32)), pa.array(found["n"].astype(np.int32))],
                names=["a", "r", "i", "lo", "n"],
            )


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``data`` ordered by the ``depth`` bytes from there on (longer
    common prefixes in any order), by two-stage sorting."""
    n = len(data)
    # small: a suffix below its successor; a run of one byte is as its end is
    change = np.flatnonzero(data[1:] != data[:-1])
    nxt = np.full(n, -1, np.int64)
    if len(change):
        at = np.searchsorted(change, np.arange(n - 1))
        ok = at < len(change)
        nxt[:-1][ok] = change[at[ok]]
    small = np.zeros(n, bool)
    some = nxt >= 0
    small[some] = data[nxt[some]] < data[nxt[some] + 1]
    ordered = _sorted_directly(data, np.flatnonzero(small), depth)
    # the last suffix has no successor: it is the first of its bucket
    counts = np.bincount(data, minlength=256)
    start = np.concatenate(([0], np.cumsum(counts)[:-1]))
    directly = np.bincount(data[small], minlength=256)
    out = np.empty(n, np.int64)
    tail = start + counts - directly
    at = 0
    for c in range(256):
        out[tail[c] : start[c] + counts[c]] = ordered[at : at + directly[c]]
        at += directly[c]
    head = start.copy()
    last = int(data[n - 1])
    out[head[last]] = n - 1
    head[last] += 1

    def induce(places: np.ndarray, own: int) -> None:
        """Put the larger predecessors of suffixes in order at the heads of their buckets."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        if own >= 0:
            before = before[data[before] != own]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        kinds, at, size = np.unique(first, return_index=True, return_counts=True)
        for c, a, k in zip(kinds.tolist(), at.tolist(), size.tolist(), strict=True):
            out[head[c] : head[c] + k] = before[a : a + k]
            head[c] += k

    for c in range(256):
        if not counts[c]:
            continue
        done = int(start[c])
        while done < head[c]:  # runs of the byte itself grow the bucket while it is scanned
            places = out[done : head[c]]
            done = int(head[c])
            before = places[places > 0] - 1
            before = before[~small[before] & (data[before] == c)]
            out[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        induce(out[start[c] : start[c] + counts[c]], c)
    return out


def _words(data: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(extra + 8, np.uint8)])
    return np.ndarray((len(data) + extra,), ">u8", padded, 0, (1,))


def _sorted_directly(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the bytes from there on, eight at a time; only ties go on."""
    word = _words(data, depth)
    key = word[places].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    tied = np.append(False, key[1:] == key[:-1])
    for at in range(8, depth, 8):
        group = np.cumsum(~tied)
        some = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(some):
            break
        own = places[some]
        key = word[own + at].astype(np.uint64)
        order = np.lexsort((key, group[some]))
        places[some] = own[order]
        key = key[order]
        tied[some] &= np.append(False, key[1:] == key[:-1])
    return places


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, ``most`` at most."""
    word = _words(data, most)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, most, 8):
        differ = word[a[live] + at].astype(np.uint64) ^ word[b[live] + at].astype(np.uint64)
        same = differ == 0
        out[live[same]] = at + 8
        odd = live[~same]
        zeros = np.zeros(len(odd), np.int64)
        for k in range(1, 8):
            zeros[differ[~same] < (np.uint64(1) << np.uint64(64 - 8 * k))] = k
        out[odd] = at + zeros
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, most)


def repeated_strings(data: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, kinds): the places of ``data`` where a wanted string starts, in
    suffix order, and a number for each run of equal ones."""
    order = suffix_array(data)
    order = order[strings[order]]
    if not len(order):
        return order, order
    equal = common(data, order[1:], order[:-1]) >= LENGTH
    return order, np.cumsum(np.append(True, ~equal)) - 1


FOUND = "i bigint, lo int, n int"
CUT = "a bigint, deep boolean, lo int, n int, single boolean, i bigint, t binary"
BLOCK = "a bigint, r bigint, i bigint, lo int, n int, off int, single boolean, t binary"


def _searched(batches):
    """Rows a, i, lo, n, single, t (bytes), sorted by a.  Gives the runs of
    strings of single regions that occur again in a region of the same a."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("t").nbytes
        if size < ARRAY:
            continue
        table = pa.Table.from_batches(held)
        key = table["a"].to_numpy()
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from _in_arrays(table.slice(0, cut))
        rest = table.slice(cut)
        held, size = rest.to_batches(), rest["t"].nbytes
    if held:
        yield from _in_arrays(pa.Table.from_batches(held))


def _in_arrays(table: pa.Table):
    """Split at groups so that an array has about ARRAY bytes."""
    if not table.num_rows:
        return
    key = table["a"].to_numpy()
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.cumsum(pc.binary_length(table["t"]).to_numpy())
    at = 0
    while at < len(head):
        base = ends[head[at] - 1] if head[at] else 0
        stop = max(at + 1, int(np.searchsorted(ends[np.append(head[1:], len(ends)) - 1], base + ARRAY)))
        last = head[stop] if stop < len(head) else table.num_rows
        yield from _one_array(table.slice(head[at], last - head[at]).combine_chunks())
        at = stop


def _one_array(table: pa.Table):
    raw = table["t"].to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    begin = np.cumsum(size) - size
    n, lo, ids = table["n"].to_numpy(), table["lo"].to_numpy(), table["i"].to_numpy()
    single = np.asarray(table["single"].to_numpy(zero_copy_only=False), bool)
    region = np.repeat(np.arange(len(raw)), n)
    place = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    wanted = np.zeros(len(data), bool)
    wanted[place] = True
    owner = np.zeros(len(data), np.int64)
    owner[place] = region
    places, kinds = repeated_strings(data, wanted)
    if not len(places):
        return
    again = np.bincount(kinds)[kinds] > 1
    hit = np.zeros(len(data), bool)
    hit[places[again & single[owner[places]]]] = True
    runs = np.flatnonzero(hit)
    if len(runs):
        first = np.flatnonzero(np.append(True, (runs[1:] != runs[:-1] + 1) | (owner[runs[1:]] != owner[runs[:-1]])))
        count = np.diff(np.append(first, len(runs)))
        own = owner[runs[first]]
        yield pa.record_batch([pa.array(ids[own]), pa.array((lo[own] + runs[first] - begin[own]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["i", "lo", "n"])


def _cut(batches):
    """i and the regions wanted of a text; gives them with their bytes."""
    for batch in batches:
        ids = batch.column("i").to_numpy()
        for i, text, wanted in zip(ids.tolist(), plain(batch.column("t")).cast(pa.large_binary()), batch.column("w").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            cut = [raw[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH] for w in wanted]
            part = [pa.array([w[k] for w in wanted], t) for k, t in (("a", pa.int64()), ("deep", pa.bool_()), ("lo", pa.int32()), ("n", pa.int32()), ("single", pa.bool_()))]
            yield pa.record_batch([*part, pa.array([i] * len(wanted), pa.int64()), pa.array(cut, pa.binary())], names=["a", "deep", "lo", "n", "single", "i", "t"])


def _blocks(width: int):
    """Divide regions (or blocks of an earlier step, whose column off says how
    far after its first string the anchor lies) into blocks of ``width`` starts."""

    def work(batches):
        for batch in batches:
            raw = batch.column("t").cast(pa.large_binary())
            size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            if not len(data):
                continue
            begin = np.cumsum(size) - size
            n = batch.column("n").to_numpy().astype(np.int64)
            off = batch.column("off").to_numpy().astype(np.int64) if "off" in batch.schema.names else anchors(data)[begin] - begin
            most, least = off, off - n + 1  # how far before the anchor the first and the last string start
            many = most // width - least // width + 1
            row = np.repeat(np.arange(len(n)), many)
            block = least[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            far, near = np.minimum(most[row], block * width + width - 1), np.maximum(least[row], block * width)
            skip, count = most[row] - far, far - near + 1
            start = begin[row] + skip
            stop = start + count - 1 + LENGTH
            core = begin[row] + off[row] - block * width
            power, inverse = _powers(len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE[data] * power[: len(data)], out=sums[1:])

            def hashed(a, b, tags):
                h = (sums[b] - sums[a]) * inverse[a]  # noqa: B023
                for tag in tags:
                    h = (h ^ (h >> np.uint64(31))) * ODD + tag.astype(np.uint64)
                return pa.array(((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64))

            own = np.frombuffer(b"".join(data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint8)
            ends = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64)
            bytes_ = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(own)]).cast(pa.binary())
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.record_batch(
                [hashed(core, core + LENGTH - width + 1, [block]), hashed(start, stop, [count, far]), batch.column("i").take(pa.array(row)), ints(batch.column("lo").to_numpy()[row] + skip), ints(count), ints(far), batch.column("single").take(pa.array(row)), bytes_],
                names=["a", "r", "i", "lo", "n", "off", "single", "t"],
            )

    return work


def _compared(kinds: DataFrame, single: Column) -> DataFrame:
    """a, deep: keys with a single region that others may repeat, and whether
    they have too many regions for one array."""
    sizes = kinds.groupBy("a").agg(F.count("*").alias("k"), F.count_if(single).alias("u")).where("u > 0 AND k > 1")
    return written(sizes.select("a", (F.col("k") > TOGETHER).alias("deep")), "compared")


def repeats(texts: DataFrame) -> DataFrame:
    """i, lo, n: runs of n strings from byte lo on that occur again, of
    ``texts`` (i bigint, unique and not null; t string).  Runs may overlap."""
    listed = written(texts.select("i", "t").mapInArrow(_listed, REGION), "regions")
    often = written(listed.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "anchors")
    some = written(listed.join(often, "a"), "repeated")
    dropped(texts.sparkSession, listed)
    kinds = written(some.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(F.struct("i", "lo", "n")).alias("one")), "kinds")
    equal = some.join(written(kinds.where("c > 1").select("a", "r"), "equal"), ["a", "r"]).select("i", "lo", "n")
    single = F.col("c") == 1
    sizes = _compared(kinds, single)
    wanted = kinds.join(sizes, "a").select("a", "deep", "one.i", "one.lo", "one.n", single.alias("single"))
    lists = wanted.groupBy("i").agg(F.collect_list(F.struct("a", "deep", "lo", "n", "single")).alias("w"))
    cut = texts.select("i", "t").join(written(lists, "wanted"), "i").mapInArrow(_cut, CUT)
    met, deep = cut, not sizes.where("deep").isEmpty()
    if deep:
        cut = written(cut, "cut")
        met, rows = cut.where("NOT deep"), cut.where("deep").drop("deep")
    met = met.select("a", "i", "lo", "n", "single", "t")
    for width in WIDTHS:
        if not deep:
            break
        blocks = written(rows.mapInArrow(_blocks(width), BLOCK), "blocks")
        kinds = written(blocks.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(F.struct("i", "lo", "n", "off", "single", "t")).alias("one")), "kinds")
        equal = equal.unionByName(blocks.where("single").join(written(kinds.where("c > 1").select("a", "r"), "equal"), ["a", "r"]).select("i", "lo", "n"))
        single = (F.col("c") == 1) & F.col("one.single")
        sizes = _compared(kinds, single)
        deep = width > 1 and not sizes.where("deep").isEmpty()
        rows = kinds.join(sizes, "a").select("a", "deep", "one.i", "one.lo", "one.n", "one.off", single.alias("single"), "one.t")
        if deep:
            rows = written(rows, "cut")
            met = met.unionByName(rows.where("NOT deep").drop("deep", "off"))
            rows = rows.where("deep").drop("deep")
        else:
            met = met.unionByName(rows.drop("deep", "off"))
    inside = met.repartition("a").sortWithinPartitions("a").mapInArrow(_searched, FOUND)
    return equal.unionByName(inside)


def _kept(batches):
    kind = pa.string()
    for batch in batches:
        out = []
        for text, runs in zip(plain(batch.column("t")).cast(pa.large_binary()), batch.column("w").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            spans: list[list[int]] = []
            for lo, n in sorted((w["lo"], w["n"]) for w in runs or []):
                stop = lo + n - 1 + LENGTH
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([lo, stop])
            digest, at, removed = hashlib.sha256(), 0, 0
            for a, b in spans:
                digest.update(raw[at:a])
                removed, at = removed + b - a, b
            digest.update(raw[at:])
            out.append((len(raw), removed, len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        if out:
            cols = list(zip(*out, strict=True))
            spans = pa.array(cols[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], kind), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (the bytes
    removed) of every row, after removal of each byte that a string of LENGTH
    bytes covers which also starts anywhere else."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    known = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if known["n"] == known["d"]:
        texts = rows.withColumn("i", F.col("doc_id"))
    else:  # equal or null ids: rows get numbers of their own, fixed in a table
        texts = written(rows.withColumn("i", F.monotonically_increasing_id()), "numbered")
    lists = repeats(texts).groupBy("i").agg(F.collect_list(F.struct("lo", "n")).alias("w"))
    out = texts.join(written(lists, "lists"), "i", "left").select("doc_id", "t", "w")
    return out.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: int, end: int>>")
