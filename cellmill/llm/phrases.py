"""Phrase collocations by hierarchical pair naming.

Words get ids; a phrase of k words is the pair of the two phrases of k - 1 words
that it holds.  Level by level, neighbouring ids of frequent phrases are
replaced by the id of their pair, which all tasks agree on by one exchange of
counted pairs.  The pair of ids is also the phrase's pointer to its parents:
the counts of first and last parts, of which every cut needs two, and the
longer phrases that hold a phrase, are found by joins on ids, never on words.

Texts are coded once in blocks of one language: a block has its own dictionary,
so that exchanges carry each distinct word or pair of a block once, with its
count, whatever a word's frequency.  A pair's rows are then at most the blocks.
A task that names pairs answers each block by messages of many ids, since the
rows of frequent pairs grow faster than the texts until most pairs are frequent.
A block's codes follow the order of ids, so that its rows and messages ascend
and their differences are small.

A phrase is a candidate if it occurs LEAST times or more; so are all its parts,
which is why infrequent words and pairs take no further part, and why a phrase
that holds another is always found among the phrases one word longer.

Edge cases: a null text is the empty text, a null language is ``und``; texts
without words count nothing; a piece of fewer words than a phrase has none; an
empty table gives no rows; equal phrases of two languages are two phrases;
repeated documents count as often as they are there; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textbatch import pieces, plain

LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate is dropped if a longer one has this share, in hundredths, of its count.
HELD = 50
SCALE = 1_000_000
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK = 16 << 20
#: Ids that a naming task holds before it sends them to their blocks, about.
SENT = 1 << 20

_BLANK, _STOP = b"\t ", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_STOP)] = 1, 2

CODED = "block bigint, lang string, n bigint, grams binary, words array<string>, counts array<bigint>"
PAIRED = "block bigint, p int, left bigint, right bigint, c bigint, grams binary"
NAMED = "id bigint, left bigint, right bigint, f bigint, block bigint, codes binary"


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(grams, words): ``words[grams[i]]`` are the words of the texts one after
    the other, -1 stands between pieces."""
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    heads = offsets[:-1] - offsets[0]
    kind = _KIND[data]
    inside = kind == 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = heads[(heads > 0) & (heads < len(data))]  # texts lie side by side
    start[edge] |= inside[edge]
    end[edge - 1] |= inside[edge - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    if not len(first):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    ends = np.concatenate(([0], np.cumsum(last - first + 1)))
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    named = binary.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), first) + np.searchsorted(heads, first, side="right")
    shift = np.concatenate(([0], np.cumsum(np.diff(piece) > 0)))
    grams = np.full(len(first) + int(shift[-1]), -1, np.int32)
    grams[np.arange(len(first)) + shift] = named.indices.to_numpy(zero_copy_only=False)
    return grams, named.dictionary.cast(pa.large_string()).cast(pa.string())


def blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """A row a block: its language, number of words, coded words, and its distinct
    words with their counts."""

    def work(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = pc.fill_null(batch.column(0), "und").dictionary_encode()
            for k, lang in enumerate(names.dictionary.to_pylist()):
                for run in pieces(plain(batch.column(1).filter(pc.equal(names.indices, k))), BLOCK):
                    grams, words = coded(run)
                    if len(words):
                        counts = np.bincount(grams[grams >= 0], minlength=len(words))
                        yield pa.record_batch(
                            [pa.array([block]), pa.array([lang], pa.string()), pa.array([int(counts.sum())]), pa.array([grams.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                            names=["block", "lang", "n", "grams", "words", "counts"],
                        )
                        block += 1

    return docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(work, CODED)


def paired(batches, last: bool):
    """Pairs of neighbouring frequent phrases of each block, with their counts, and
    unless it is the ``last`` level the block in codes of these pairs (column grams).

    Rows (block, p, id, grams, codes) come block by block, first the block's grams,
    then the ids of the codes that are frequent: one in columns p and id, or those
    of a message, see :func:`messages`."""
    names = ["block", "p", "left", "right", "c", "grams"]
    open_, grams, known = None, None, []

    def done():
        p, ids = (np.concatenate([x[k] for x in known] or [np.zeros(0, np.int64)]) for k in range(2))
        order = np.argsort(ids)
        ids, size = ids[order], len(ids)
        rank_of = np.full(int(grams.max(initial=-1)) + 2, -1, np.int64)  # the last code stands for none
        rank_of[p[order]] = np.arange(size)
        ranks = rank_of[grams]
        both = (ranks[:-1] >= 0) & (ranks[1:] >= 0)
        keys, inverse, counts = np.unique(ranks[:-1][both] * size + ranks[1:][both], return_inverse=True, return_counts=True)
        if not last:
            after = np.full(len(grams), -1, np.int32)
            after[:-1][both] = inverse
            none = lambda t: pa.array([None], t)
            yield pa.record_batch([pa.array([open_]), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array([after.tobytes()], pa.binary())], names=names)
        for at in range(0, len(keys), 1 << 18):
            k = keys[at : at + (1 << 18)]
            yield pa.record_batch([pa.array(np.full(len(k), open_)), pa.array(np.arange(at, at + len(k)), pa.int32()), pa.array(ids[k // size]), pa.array(ids[k % size]), pa.array(counts[at : at + len(k)]), pa.nulls(len(k), pa.binary())], names=names)

    for batch in batches:
        block, p, ids = (pc.fill_null(batch.column(k), -1).to_numpy(zero_copy_only=False) for k in range(3))  # nulls would make floats of ids
        many = batch.column(4)
        sent = many.is_valid().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if block[a] != open_:
                if open_ is not None:
                    yield from done()
                open_, grams, known = int(block[a]), np.frombuffer(batch.column(3)[a].as_py(), np.int32), []
                a += 1
            one = ~sent[a:b]
            known.append((p[a:b][one].astype(np.int64), ids[a:b][one].astype(np.int64)))
            for at in (np.flatnonzero(sent[a:b]) + a).tolist():
                codes, more = unpacked(many[at].as_py())
                known.append((codes, more + ids[at]))
    if open_ is not None:
        yield from done()


def packed(p: np.ndarray, more: np.ndarray) -> bytes:
    """Both columns by their differences, lowest bytes first, then the next: where
    differences are small the rest is zeros, which Spark's codec makes short."""
    steps = np.diff(np.stack((p, more)), axis=1, prepend=0).astype("<i4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(codes: bytes) -> np.ndarray:
    """What :func:`packed` was given, as two rows."""
    steps = np.frombuffer(codes, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(2, -1)
    return steps.cumsum(axis=1, dtype=np.int64)


def messages(block: np.ndarray, p: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row a block: its codes ``p`` and then their ids, less the row's id."""
    order = np.argsort(block, kind="stable")
    block, p, ids = block[order], p[order], ids[order]
    head = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    size = np.diff(np.append(head, len(block)))
    first = np.minimum.reduceat(ids, head) if len(head) else ids
    ids = ids - np.repeat(first, size)
    codes = [packed(p[a : a + n], ids[a : a + n]) for a, n in zip(head.tolist(), size.tolist(), strict=True)]
    none = pa.nulls(len(head), pa.int64())
    return pa.record_batch([pa.array(first), none, none, none, pa.array(block[head]), pa.array(codes, pa.binary())], names=["id", "left", "right", "f", "block", "codes"])


def named(batches, least: int, most: int = SENT):
    """Ids for pairs that occur ``least`` times or more, in all blocks together.

    Rows (left, right, c, block, p) come in order of the pair.  Out come one row a
    frequent pair (its count f; no block) and for the blocks that have it its code
    p there, in :func:`messages` of about ``most`` codes together.  A pair's rows
    are passed on as soon as it is known to be frequent, so fewer than ``least`` of
    them are held besides."""
    from pyspark import TaskContext

    id_, kept = TaskContext.get().partitionId() << 40, np.zeros((0, 5), np.int64)
    open_: tuple[int, int, int, int] | None = None  # left, right, id, count so far of a frequent pair
    sent, waiting = [], 0

    def whole(rows):
        a = np.array(rows, np.int64).reshape(-1, 4)
        return pa.record_batch([pa.array(a[:, 2]), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 3]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], names=["id", "left", "right", "f", "block", "codes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([kept, np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], axis=1)])
        head = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        size, total = np.diff(np.append(head, len(rows))), np.add.reduceat(rows[:, 2], head)
        ids = np.full(len(head), -1, np.int64)
        if open_ is not None:
            if (rows[0, 0], rows[0, 1]) == open_[:2]:
                ids[0], total[0] = open_[2], total[0] + open_[3]
            else:
                yield whole([open_])
        new = np.flatnonzero((total >= least) & (ids < 0))
        ids[new] = id_ + np.arange(len(new))
        id_ += len(new)
        passed = np.repeat(ids, size)
        own = passed >= 0
        sent.append((rows[own, 3], rows[own, 4], passed[own]))
        waiting += int(own.sum())
        if waiting >= most:
            yield messages(*map(np.concatenate, zip(*sent, strict=True)))
            sent, waiting = [], 0
        ended = np.flatnonzero(ids[:-1] >= 0)
        yield whole(np.stack([rows[head[ended], 0], rows[head[ended], 1], ids[ended], total[ended]], axis=1))
        at = head[-1]
        open_ = (int(rows[at, 0]), int(rows[at, 1]), int(ids[-1]), int(total[-1])) if ids[-1] >= 0 else None
        kept = rows[at:] if open_ is None else rows[:0]
    if waiting:
        yield messages(*map(np.concatenate, zip(*sent, strict=True)))
    if open_ is not None:
        yield whole([open_])


def least_cut(a: Column, heads: Column, tails: Column) -> Column:
    """struct(score, k, l, r): the cut of the lowest score, of equal ones the first.
    Counts have at most 16 digits, products 38."""
    cuts = F.arrays_zip(heads.alias("l"), tails.alias("r"), F.sequence(F.lit(1), F.size(heads)).alias("k"))
    high = (F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(16,0)")).cast("decimal(22,0)") * a.cast("decimal(16,0)")
    low = lambda x: x["l"].cast("decimal(19,0)") * x["r"].cast("decimal(19,0)")
    return F.array_min(F.transform(cuts, lambda x: F.struct(F.call_function("div", high, low(x)).alias("score"), x["k"].alias("k"), x["l"].alias("l"), x["r"].alias("r"))))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every candidate of 2 to ``longest``
    words that no longer one holds."""
    start = written(blocks(docs, text_col, lang_col), "blocks")
    words = start.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("p", "x")).select("block", "lang", "p", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counted = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    grams = written(counted.withColumn("id", F.monotonically_increasing_id()), "frequent-words")
    none = F.lit(None).cast("binary")
    places = words.join(grams, ["lang", "word"]).select("block", "p", "id", none.alias("grams"), none.alias("codes"))
    level = grams.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
    state, found = start.select("block", "grams"), []
    for size in range(2, longest + 1):
        rows = state.select("block", F.lit(-1).alias("p"), F.lit(None).cast("long").alias("id"), "grams", none.alias("codes")).unionByName(places)
        last = size == longest
        dealt = rows.repartition("block").sortWithinPartitions("block", "p")
        pairs = dealt.mapInArrow(lambda b, last=last: paired(b, last), PAIRED)
        if last:
            names = pairs.groupBy("left", "right").agg(F.sum("c").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())
        else:
            pairs = written(pairs, "pairs")
            ordered = pairs.where("grams IS NULL").select("left", "right", "c", "block", "p").repartition("left", "right").sortWithinPartitions("left", "right")
            both = written(ordered.mapInArrow(lambda b: named(b, least), NAMED), "named-pairs")
            names = both.where("block IS NULL").select("id", "left", "right", "f")
            places = both.where("block IS NOT NULL").select("block", F.lit(0).alias("p"), "id", none.alias("grams"), "codes")
            state = pairs.where("grams IS NOT NULL").select("block", "grams")
        names = written(names.select("id", "left", "right", "f"), "names")
        one, two = (level.select(*(F.col(c).alias(f"{s}_{c}") for c in level.columns)) for s in ("l", "r"))
        both = names.join(one, F.col("left") == F.col("l_id")).join(two, F.col("right") == F.col("r_id"))
        # columns of the next level; its parents stay for the test of what holds what
        level = written(
            both.select(
                "id", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), "f",
                F.concat("l_heads", F.array("l_f")).alias("heads"), F.concat(F.array("r_f"), "r_tails").alias("tails"),
            ),
            "phrases",
        )
        if found:
            held = names.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("__f"))
            found[-1] = found[-1].join(held, "id", "left").where(F.coalesce(100 * F.col("__f") < HELD * F.col("f"), F.lit(True))).drop("__f")
        found.append(level.withColumn("words", F.lit(size)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    n = start.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = out.withColumn("cut", least_cut(F.col("f"), F.col("heads"), F.col("tails")))
    return scored.join(n, "lang").select("lang", "phrase", "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def best(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, least, longest, text_col, lang_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
