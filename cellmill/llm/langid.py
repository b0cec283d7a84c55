"""Language identification by interpolated Kneser-Ney character models.

One model a language, over the letters of each word between word marks.  The
n-gram counts come from every learning text and none is left out: Spark sums
them, and makes of them the counts of shorter n-grams, the discounted
probability of each n-gram and the weight that each context leaves to the
shorter n-gram.  All of that lies in files of the shared folder, dealt and
sorted by 64-bit n-gram hashes, where tasks look the n-grams of their texts
up; the driver knows the files' names and ranges only.  A text goes to the language of the lowest cross-entropy a
letter; how unusual that entropy is for the language, against a bounded
labelled sample, decides on rejection.

Edge cases: a null text, an empty one and one without a letter are ``und``
with score 0; rows with a null label teach nothing; ties go to the first label
in alphabetical order; texts are scored whole, whatever their length; repeated
rows get equal results; an empty table gives an empty table, and learning from
no row at all predicts ``und``; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened
from .scratch import new_dir, written
from .textbatch import gathered, in_pieces, pieces, plain, words

ORDER, BITS = 4, 16
START, END = 1, 2
#: Rows of a file of the model, about.
SHARD_ROWS = 1 << 17
#: Rows of the model that a Python worker keeps in memory; files beyond them are
#: read again for each run of texts.
KEPT_ROWS = 4_000_000
UNKNOWN = "und"
SCORE = "lang string, score double, entropy double, rejected boolean"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): the n-grams of highest order of each word, one after the
    other, and how many each word has (letters and the end mark; 0 without a
    letter).  A key holds ORDER characters of 16 bits, the last lowest."""
    text = "\n".join(distinct.to_pylist()) + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = code == 10
    keep = letters()[code] | stop
    owner = (np.cumsum(stop) - stop)[keep]
    code = code[keep].astype(np.uint64)
    stop = code == 10
    code = np.where(stop, END, (code ^ (code >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.uint64)
    head = np.append(True, stop[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(code)), 0))
    back = np.arange(len(code)) - first
    keys = code.copy()
    for j in range(1, ORDER):
        before = np.full(len(code), START, np.uint64)
        ok = back >= j
        before[ok] = code[np.flatnonzero(ok) - j]
        keys |= before << np.uint64(BITS * j)
    counts = np.bincount(owner, minlength=len(distinct))
    bare = counts == 1  # the end mark alone
    return keys[~bare[owner]].view(np.int64), np.where(bare, 0, counts)


def counted(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """lang, key, n: how often each n-gram occurs in the texts of each label.

    Every row with a label counts.  Tasks sum what they hold before Spark
    shuffles the sums.
    """

    def work(batches):
        for batch in batches:
            labels = batch.column(1).dictionary_encode()
            code = labels.indices.to_numpy(zero_copy_only=False)
            texts = plain(batch.column(0))
            for i, lang in enumerate(labels.dictionary.to_pylist()):
                sums: list[tuple[np.ndarray, np.ndarray]] = []
                for run in pieces(texts.take(pa.array(np.flatnonzero(code == i))), 8 << 20):
                    codes, distinct, _ = words(pc.utf8_lower(run))
                    keys, size = ngrams(distinct)
                    n = np.repeat(np.bincount(codes, minlength=len(distinct)), size)
                    found, at = np.unique(keys, return_inverse=True)
                    sums.append((found, np.bincount(at, weights=n, minlength=len(found))))
                if sums:
                    found, at = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([x for _, x in sums]), minlength=len(found))
                    yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    some = rows.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    return some.mapInArrow(work, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """grams[k], share[k]: sorted hashes of order k + 1 and their discounted
    probability; contexts[k], left[k]: those of k characters and the weight
    that they leave to order k."""

    lang: str
    grams: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    usual: float = 0.0
    spread: float = float("inf")

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        p = np.full(len(keys), 1.0 / 65536)
        for k in range(ORDER):
            own = keys & _mask(k + 1)
            p = _found(self.grams[k], self.share[k], own, 0.0) + _found(self.contexts[k], self.left[k], own >> np.uint64(BITS), 1.0) * p
        return np.log(p)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


def _found(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], default)


def kneser_ney(lang: str, keys: np.ndarray, counts: np.ndarray) -> Model:
    """The interpolated model of n-grams of the highest order and their counts;
    shorter n-grams count the distinct characters that precede them."""
    model = Model(lang)
    keys, counts = keys.view(np.uint64), counts.astype(np.float64)
    levels = [(keys, counts)]
    for k in range(ORDER - 1, 0, -1):
        shorter, n = np.unique(levels[0][0] & _mask(k), return_counts=True)
        levels.insert(0, (shorter, n.astype(np.float64)))
    for grams, n in levels:
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, at, kinds = np.unique(grams >> np.uint64(BITS), return_inverse=True, return_counts=True)
        total = np.bincount(at, weights=n)
        order = np.argsort(grams)
        model.grams.append(grams[order])
        model.share.append((np.maximum(n - discount, 0) / total[at])[order])
        model.contexts.append(contexts)
        model.left.append(discount * kinds / total)
    return model


@dataclass
class Models:
    """The models of all labels: their names in alphabetical order, the files
    with the rows of each kind (``k`` for n-grams of k + 1 characters, ``ORDER
    + k`` for contexts of k) as (uri, least key, greatest key), and what
    entropy is usual."""

    langs: list[str]
    files: list[list[tuple[str, int, int]]]
    usual: list[float]
    spread: list[float]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """A row a key, a column a language."""
        keys = keys.view(np.uint64)
        p = np.full((len(keys), len(self.langs)), 1.0 / 65536)
        for k in range(ORDER):
            own = keys & _mask(k + 1)
            share, left = self._values(k, own, 0.0), self._values(ORDER + k, own >> np.uint64(BITS), 1.0)
            p = share + left * p
        return np.log(p)

    def _values(self, kind: int, keys: np.ndarray, default: float) -> np.ndarray:
        wanted, back = np.unique(keys.view(np.int64), return_inverse=True)
        out = np.full((len(wanted), len(self.langs)), default)
        for uri, least, greatest in self.files[kind]:
            a, b = np.searchsorted(wanted, least), np.searchsorted(wanted, greatest, side="right")
            if a < b:
                known, lang, value = _rows(uri)[kind]
                first = np.searchsorted(known, wanted[a:b])
                n = np.searchsorted(known, wanted[a:b], side="right") - first
                at = gathered(first, n)
                out[np.repeat(np.arange(a, b), n), lang[at]] = value[at]
        return out[back]


_KEPT: dict[str, dict] = {}


def _rows(uri: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{kind: (sorted keys, languages, values)} of a file of the model."""
    if uri in _KEPT:
        return _KEPT[uri]
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        table = pq.read_table(f, columns=["kind", "key", "lang", "value"])
    kind, key, lang, value = (x.to_numpy() for x in table.columns)
    kinds, first = np.unique(kind, return_index=True)
    out = {int(k): (key[a:b], lang[a:b], value[a:b]) for k, a, b in zip(kinds, first, [*first[1:], len(kind)], strict=True)}
    if sum(len(x[0]) for rows in _KEPT.values() for x in rows.values()) + len(kind) > KEPT_ROWS:
        if all(x.rsplit("/", 1)[0] == uri.rsplit("/", 1)[0] for x in _KEPT):
            return out
        _KEPT.clear()  # those of another model
    _KEPT[uri] = out
    return out


def kneser_ney_tables(counts: DataFrame, langs: list[str]) -> DataFrame:
    """kind, key, lang (its place in ``langs``), value: what :func:`kneser_ney`
    has in arrays, of every label, from ``counts`` (lang, key, n)."""
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    level = counts.select(place.alias("lang"), F.lit(ORDER - 1).alias("k"), "key", "n")
    grams = level
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("key")).agg(F.count("*").alias("n")).select("lang", F.lit(k - 1).alias("k"), "key", "n")
        grams = grams.unionByName(level)
    grams = written(grams.withColumn("context", F.shiftrightunsigned("key", BITS)), "grams")
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discounts = grams.groupBy("lang", "k").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("discount"))
    contexts = grams.groupBy("lang", "k", "context").agg(F.count("*").alias("kinds"), F.sum("n").cast("double").alias("total")).join(F.broadcast(discounts), ["lang", "k"])
    shares = grams.join(contexts, ["lang", "k", "context"]).select(F.col("k").alias("kind"), "key", "lang", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("value"))
    left = contexts.select((F.col("k") + ORDER).alias("kind"), F.col("context").alias("key"), "lang", (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
    return shares.unionByName(left)


def fitted(rows: DataFrame, text_col: str = "text", label_col: str = "lang", calibrated: bool = True) -> Models:
    """The models of the labels of ``rows``.

    All rows are counted and every n-gram is kept, in files of the shared
    folder.  Calibration scores all labelled rows.
    """
    counts = written(counted(rows, text_col, label_col), "ngrams")
    sizes = {r["lang"]: r["c"] for r in counts.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    langs = sorted(sizes)
    models = Models(langs, [[] for _ in range(2 * ORDER)], [0.0] * len(langs), [float("inf")] * len(langs))
    if not langs:
        return models
    path = new_dir(rows.sparkSession, "languages")
    parts = max(4, -(-2 * sum(sizes.values()) // SHARD_ROWS))
    table = written(kneser_ney_tables(counts, langs).repartitionByRange(parts, "kind", "key").sortWithinPartitions("kind", "key"), "languages", path)
    for r in table.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "kind").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect():
        models.files[r["kind"]].append((f"{path}/{r['file']}", r["a"], r["b"]))
    if calibrated:
        scored = identified(rows.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).alias("l")), models, "t", "s")
        for row in scored.where("s.lang = l").groupBy("l").agg(F.avg("s.entropy").alias("m"), F.stddev("s.entropy").alias("d")).collect():
            at = langs.index(row["l"])
            models.usual[at], models.spread[at] = row["m"], row["d"] if row["d"] is not None else float("inf")
    return models


def identified(docs: DataFrame, models: Models, text_col: str = "text", into: str = "language", temperature: float = 4.0, deviations: float = 6.0) -> DataFrame:
    """``docs`` with a struct column ``into``: the language, the probability of
    it among the models (log-likelihoods divided by ``temperature``), the
    cross-entropy a letter, and whether that lies more than ``deviations``
    standard deviations above what is usual for the language."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def work(run: pa.Array) -> pa.Array:
        models = shared.value
        codes, distinct, offsets = words(pc.utf8_lower(run))
        keys, size = ngrams(distinct)
        found, at = np.unique(keys, return_inverse=True)
        ends = np.cumsum(size)
        at_word = np.concatenate(([0], np.cumsum(size[codes])))
        n = (at_word[offsets[1:]] - at_word[offsets[:-1]]).astype(np.float64)
        loss = np.zeros((len(run), max(1, len(models.langs))))
        for j, own in enumerate(models.log_probability(found).T):
            each = np.concatenate(([0.0], np.cumsum(own[at])))
            of_word = (each[ends] - each[ends - size])[codes]
            sums = np.concatenate(([0.0], np.cumsum(of_word)))
            loss[:, j] = -(sums[offsets[1:]] - sums[offsets[:-1]])
        best = loss.argmin(axis=1)
        known = (n > 0) & bool(models.langs)
        entropy = loss / np.maximum(n, 1)[:, None]
        share = np.exp((loss.min(axis=1)[:, None] - loss) / temperature)
        score = np.where(known, 1.0 / share.sum(axis=1), 0.0)
        names = pa.array([*models.langs, UNKNOWN], pa.string())
        usual = np.array([m + deviations * d for m, d in zip(models.usual, models.spread, strict=True)] or [0.0])
        lowest = entropy[np.arange(len(run)), best]
        return pa.StructArray.from_arrays(
            [names.take(pa.array(np.where(known, best, len(models.langs)))), pa.array(score), pa.array(np.where(known, lowest, 0.0)), pa.array(~known | (lowest > usual[best]))],
            fields=list(kind),
        )

    @F.arrow_udf(SCORE)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, work, kind)

    return docs.withColumn(into, run(F.col(text_col)))
