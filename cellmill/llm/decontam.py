"""Benchmark decontamination by spaced-seed hashing.

Texts become words of letters and digits in lower case.  A fixed mask names
which words of a stretch count; the hash of those words joins texts with
benchmark items whatever stands at the ignored places.  Around each hit the
texts are laid side by side on its diagonal.  The longest stretch there that
has the wanted share of equal words is an overlap if it is long enough, and so
is the longest one in what it leaves of the diagonal on either side.

The masks together hit every stretch of LEAST words or more of which a fifth
is replaced, and every shorter item.  Tests try all placements in 12 to 23
words; a longer stretch can be cut into parts of such lengths, and one of them
has no more than its fifth replaced.  So no overlap is missed.

Edge cases: null and empty texts and items overlap nothing; an item shorter
than LEAST words must occur in full, with a fifth replaced at most, and have
at least SHORTEST words; null ids are kept; repeated rows each get their
overlaps; empty tables give empty tables; texts are searched whole; words that
repeat without end give many diagonals, looked at in blocks of bounded size.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import gathered, pieces, plain, words

#: Which words of a stretch a seed hashes (1) and which it ignores (0).
MASKS = ("101111", "1110011")
#: Those that items of fewer than LEAST words need besides.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Words that an overlap covers at least, and the share of equal ones.
LEAST, SHARE = 12, 0.8
#: Words of the shortest item that is searched for.
SHORTEST = 5
_KEPT, _LOST = Fraction(SHARE).limit_denominator(1000).as_integer_ratio()
_LOST -= _KEPT
#: Benchmark words searched for in one pass; a longer benchmark takes several.
PASS_WORDS = 1 << 20
#: Places of an item beside a text, and words on them, handled at a time.
BLOCK = 1 << 20
FOUND = "doc_id bigint, item_id bigint, start_word int, n_words int, n_equal int"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of the texts, and where each text's begin."""
    codes, distinct, offsets = words(texts)
    cores = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "").to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) if x else 0 for x in cores), np.uint64, len(cores))[codes]
    keep = hashes != 0
    return hashes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def seeds(hashes: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash at each place where the mask fits in a text, and the places."""
    last = np.repeat(offsets[1:], np.diff(offsets)) - len(mask)
    at = np.flatnonzero(np.arange(len(hashes)) <= last)
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ hashes[at + k]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out, at


class Benchmark:
    """Items as word hashes, and the sorted seeds of each mask."""

    def __init__(self, ids: list[int], texts: pa.Array):
        self.ids = ids
        self.hashes, self.offsets = word_hashes(texts)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.offsets))
        self.sorted = []
        short = np.diff(self.offsets)[self.item] < LEAST
        for mask in MASKS + SHORT_MASKS:
            seed, at = seeds(self.hashes, self.offsets, mask)
            if mask in SHORT_MASKS:
                seed, at = seed[short[at]], at[short[at]]
            order = np.argsort(seed, kind="stable")
            self.sorted.append((seed[order], at[order]))
        sift = np.zeros(1 << 22, bool)
        for seed, _ in self.sorted:
            sift[(seed >> np.uint64(42)).astype(np.int64)] = True
        self.sift = sift

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, equal words) of every overlap."""
        hashes, offsets = word_hashes(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        found = []
        for mask, (known, places) in zip(MASKS + SHORT_MASKS, self.sorted, strict=True):
            if not len(known):
                continue
            seed, at = seeds(hashes, offsets, mask)
            some = np.flatnonzero(self.sift[(seed >> np.uint64(42)).astype(np.int64)])
            seed, at = seed[some], at[some]
            a, b = np.searchsorted(known, seed), np.searchsorted(known, seed, side="right")
            n = b - a
            hit = np.flatnonzero(n)
            at, a, n = at[hit], a[hit], n[hit]
            ends = np.cumsum(n)
            done = 0
            while done < len(at):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK)))
                own = np.repeat(at[done:stop], n[done:stop])
                theirs = places[gathered(a[done:stop], n[done:stop])]
                item = self.item[theirs]
                # a diagonal: the text's word that would lie beside the item's first
                found.append(np.unique(np.stack([text[own], item, own - (theirs - self.offsets[item])], axis=1), axis=0))
                done = stop
        if not found:
            return []
        diagonals, out = np.unique(np.concatenate(found), axis=0), []
        size = np.diff(self.offsets)
        ends = np.cumsum(size[diagonals[:, 1]])
        done = 0
        while done < len(diagonals):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK)))
            out += self._verified(diagonals[done:stop], hashes, offsets)
            done = stop
        return out

    def _verified(self, diagonals: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The overlaps on some diagonals (text, item, shift)."""
        t, i, shift = diagonals.T
        words_of = self.offsets[i + 1] - self.offsets[i]
        first, last = np.maximum(offsets[t], shift), np.minimum(offsets[t + 1], shift + words_of)
        n = last - first
        beside = self.offsets[i] + first - shift
        equal = hashes[gathered(first, n)] == self.hashes[gathered(beside, n)]
        ends = np.cumsum(n)
        sums = np.concatenate(([0], np.cumsum(equal)))
        # too few equal words on the whole diagonal: no stretch of it can do
        need = np.minimum(LEAST, words_of)
        likely = np.flatnonzero((sums[ends] - sums[ends - n]) * (_KEPT + _LOST) >= need * _KEPT)
        out = []
        for k in likely.tolist():
            for start, size, same in stretches(equal[ends[k] - n[k] : ends[k]], int(words_of[k])):
                out.append((int(t[k]), int(i[k]), int(first[k] - offsets[t[k]]) + start, size, same))
        return out


def stretches(equal: np.ndarray, item_words: int) -> list[tuple[int, int, int]]:
    """(first, words, equal words) of the longest stretch, and of the longest
    ones in what is left of the diagonal before and after it, and so on."""
    out, open_ = [], [(0, len(equal))]
    while open_:
        a, b = open_.pop()
        if best := best_stretch(equal[a:b], item_words):
            out.append((a + best[0], best[1], best[2]))
            open_ += [(a, a + best[0]), (a + best[0] + best[1], b)]
    return sorted(out)


def best_stretch(equal: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
    """(first, words, equal words) of the longest stretch of at least LEAST
    words (the whole item, if it is shorter) of which SHARE are equal; of
    several the first."""
    need = min(LEAST, item_words)
    if need < SHORTEST or len(equal) < need:
        return None
    # in whole numbers, so that a share of exactly SHARE counts
    score = np.concatenate(([0], np.cumsum(np.where(equal, _LOST, -_KEPT))))
    lowest = np.minimum.accumulate(score)
    # the longest stretch that ends at an end begins where the least prefix first is as low
    first = np.searchsorted(-lowest, -score)
    n = np.arange(len(score)) - first
    end = int(n.argmax())
    if n[end] < need:
        return None
    start = int(first[end])
    return start, end - start, int(equal[start:end].sum())


def _passes(benchmark: DataFrame, id_col: str, text_col: str, words_a_pass: int) -> list:
    """Broadcast parts of the benchmark, each of about ``words_a_pass`` words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.size(F.split("t", r"\s+"))).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // words_a_pass))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).toArrow()
        yield spark.sparkContext.broadcast(Benchmark(rows["i"].to_pylist(), plain(rows["t"])))


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", words_a_pass: int = PASS_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_equal: every overlap; the words
    are counted in the text as normalised.

    The benchmark goes to the tasks in parts of a bounded number of words, each
    searched for in a pass over all texts; texts are never shuffled.
    """
    some = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def search(part):
        def work(batches):
            for batch in batches:
                at = 0
                for run in pieces(plain(batch.column(1))):
                    ids = batch.column(0).slice(at, len(run)).to_pylist()
                    at += len(run)
                    rows = [(ids[t], part.value.ids[i], a, n, same) for t, i, a, n, same in part.value.overlaps(run)]
                    if rows:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        return some.mapInArrow(work, FOUND)

    out = None
    for part in _passes(benchmark, item_col, item_text_col, words_a_pass):
        out = search(part) if out is None else out.unionByName(search(part))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words_a_pass: int = PASS_WORDS) -> Column:
    """Whether each text overlaps any item: a column of ``docs``."""

    def leaks(part):
        @F.arrow_udf("boolean")
        def run(texts: pa.Array) -> pa.Array:
            flags = [pa.array([], pa.bool_())]
            for some in pieces(plain(texts)):
                hit = np.zeros(len(some), bool)
                hit[[x[0] for x in part.value.overlaps(some)]] = True
                flags.append(pa.array(hit))
            return pa.concat_arrays(flags)

        return run(F.col(text_col))

    out = F.lit(False)
    for part in _passes(benchmark, item_col, item_text_col, words_a_pass):
        out = out | leaks(part)
    return out
