"""Toxicity by a linear-chain conditional random field.

1. Every labelled learning row is counted, equal texts once: in how many toxic
   and other texts each word and each beginning of a word (a stem) occurs.
   Those whose log odds are surely high make the lexicon, each in the bin of
   its odds.  The edges of the bins are odds, not shares of the highest ones,
   so that the words of a rare language stand beside those of a common one.
2. The field (two states a token, with features of the bins of the word, of
   its stem and of its neighbours) is fitted to a bounded sample of rows, whose
   tokens of the lexicon are labelled as their text is.  A row's own text is
   left out of the odds of its tokens.
3. Forward-backward gives every token of every text its probability; the
   highest ones and the length make the text's score, and runs of probable
   tokens are its toxic spans.

The chain of a whole batch is one product of 2 x 2 matrices with a reset at
each text, computed in blocks, so that a text may have any length.

Edge cases: a null text is the empty text, scored as a text without tokens;
rows with a null label or null id teach nothing; when no row or only one kind
of row teaches, all scores are 0; repeated rows get equal results; an empty
table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textbatch import in_pieces, pieces, plain, words

#: Rows of each kind that the field is fitted to, at most; whole texts.
MOST_ROWS = 500
#: Lengths of stems; a stem is marked by a hyphen.
STEMS = (3, 4, 5, 6, 7)
#: Odds count by the lower end of an interval of so many standard errors.
SURE = 2.5
#: Edges of the bins of log odds; what lies under the first is not in the lexicon.
EDGES = np.array([1.0, 1.5, 2.0, 3.0, 4.0])
#: Tokens that make a text's score; bounds of their log odds.
TOP, BOUND = 3, 10.0
BINS = len(EDGES) + 1


@dataclass
class Field:
    lexicon: dict[str, int]  # words and stems by their bin
    weights: np.ndarray  # state 1 against 0: bias, then bins of the word, its stem, the token before, the one after
    steps: np.ndarray  # 2 x 2 log potentials from state to state
    scale: np.ndarray  # from the evidence to the score


def core(distinct: pa.Array) -> pa.Array:
    """Words without the characters around their letters and digits."""
    return pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def stems(cores: pa.Array, size: int) -> pa.Array:
    """The first ``size`` characters of longer words and a hyphen; else empty."""
    longer = pc.greater(pc.utf8_length(cores), size)
    return pc.if_else(longer, pc.binary_join_element_wise(pc.utf8_slice_codeunits(cores, 0, size), pa.scalar("-", cores.type), pa.scalar("", cores.type)), pa.scalar("", cores.type))


def text_counts(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """word, toxic, other: in how many texts of either kind a word or stem occurs."""

    def work(batches):
        for batch in batches:
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            at = 0
            for run in pieces(plain(batch.column(0))):
                codes, distinct, offsets = words(run)
                cores = core(distinct)
                text = np.repeat(np.arange(len(run)), np.diff(offsets))
                kind = label[at : at + len(run)]
                at += len(run)
                for part in (cores, *(stems(cores, n) for n in STEMS)):
                    part = part.dictionary_encode()
                    size = max(1, len(part.dictionary))
                    pair = np.unique(text * size + part.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes])
                    n = [np.bincount((pair % size)[kind[pair // size] == k], minlength=len(part.dictionary)) for k in (1, 0)]
                    yield pa.record_batch([part.dictionary.cast(pa.string()), pa.array(n[0]), pa.array(n[1])], names=["word", "toxic", "other"])

    some = rows.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("l"))
    sums = some.mapInArrow(work, "word string, toxic bigint, other bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    return sums.where("word <> ''")


def log_odds(toxic: Column, other: Column, kinds: dict[int, int]) -> Column:
    """The lower end of the log odds of a word or stem, from its texts of
    either kind and all texts of either kind."""
    odds = F.log((toxic + 0.5) / (kinds[1] + 1)) - F.log((other + 0.5) / (kinds[0] + 1))
    return odds - SURE * F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def _binned(parts: pa.Array, lexicon: dict[str, int]) -> np.ndarray:
    coded = parts.dictionary_encode()
    known = np.fromiter((lexicon.get(x, 0) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def bins_of(distinct: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each word's odds and of the highest odds of its stems."""
    cores = core(distinct)
    return _binned(cores, lexicon), np.max([_binned(stems(cores, n), lexicon) for n in STEMS], axis=0)


def features(bins: tuple[np.ndarray, np.ndarray], codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bins of each token's word and stem, and the higher of those of the
    token before and of the token after in its text."""
    word, stem = bins[0][codes], bins[1][codes]
    both = np.maximum(word, stem)
    before, after = np.append(0, both)[: len(both)], np.append(both[1:], 0)[: len(both)]
    full = np.diff(offsets) > 0
    before[offsets[:-1][full]] = 0
    after[offsets[1:][full] - 1] = 0
    return word, stem, before, after


def _scores(weights: np.ndarray, f: tuple[np.ndarray, ...]) -> np.ndarray:
    return weights[0] + sum(weights[1 + k * BINS : 1 + (k + 1) * BINS][x] for k, x in enumerate(f))


def _messages(emit: np.ndarray, steps: np.ndarray, head: np.ndarray, block: int = 128) -> np.ndarray:
    """Forward messages (n x 2, normalised) of a chain that starts anew at ``head``.

    All blocks go forward together: first their products of 2 x 2 matrices,
    then, from the message that enters each block, the messages inside.
    """
    n = len(emit)
    rows = -(-n // block)
    m = np.zeros((2, 2, rows * block))
    for i in (0, 1):
        for j in (0, 1):
            m[i, j, :n] = np.where(head, 1.0, steps[i, j]) * emit[:, j]
    m[0, 0, n:] = m[1, 1, n:] = 1.0
    m = np.ascontiguousarray(m.reshape(2, 2, rows, block).transpose(3, 0, 1, 2))
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(block):
        (m00, m01), (m10, m11) = m[k]
        a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        if k % 4 == 3:
            size = a + b + c + d
            a, b, c, d = a / size, b / size, c / size, d / size
    into = np.empty((rows, 2))
    v, w = 0.5, 0.5
    for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[i] = v, w
        v, w = v * p + w * r, v * q + w * s
        v, w = v / (v + w), w / (v + w)
    out = np.empty((block, 2, rows))
    v, w = into[:, 0], into[:, 1]
    for k in range(block):
        (m00, m01), (m10, m11) = m[k]
        v, w = v * m00 + w * m10, v * m01 + w * m11
        size = v + w
        out[k, 0], out[k, 1] = v, w = v / size, w / size
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def marginals(score: np.ndarray, steps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of state 1 of each token, and the messages from before (with
    the token's emission) and from after (likewise)."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    score = np.clip(score, -30, 30)
    emit = np.stack([1 / (1 + np.exp(score)), 1 / (1 + np.exp(-score))], axis=1)
    full = np.diff(offsets) > 0
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[offsets[:-1][full]] = True
    tail[offsets[1:][full] - 1] = True
    step = np.exp(steps)
    alpha = _messages(emit, step, head)
    gamma = _messages(emit[::-1], step.T, tail[::-1])[::-1]
    p = alpha * gamma / emit
    return p[:, 1] / p.sum(axis=1), alpha, gamma


def transitions(alpha: np.ndarray, gamma: np.ndarray, steps: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected transitions (2 x 2), summed over the tokens ``inner`` and those
    before them."""
    x = alpha[inner - 1][:, :, None] * np.exp(steps) * gamma[inner][:, None, :]
    return (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _fit(f: tuple[np.ndarray, ...], offsets: np.ndarray, state: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and steps of the largest likelihood, by Adam over the whole sample."""
    size = 1 + len(f) * BINS
    x = np.zeros(size + 4)
    head = np.zeros(len(state), bool)
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    inner = np.flatnonzero(~head)
    seen = np.bincount(2 * state[inner - 1] + state[inner], minlength=4)
    first, second = np.zeros_like(x), np.zeros_like(x)
    toxic = max(1, int(state.sum()))
    for t in range(1, rounds + 1):
        p, alpha, gamma = marginals(_scores(x[:size], f), x[size:].reshape(2, 2), offsets)
        moved = transitions(alpha, gamma, x[size:].reshape(2, 2), inner)
        off = p - state
        grad = np.concatenate([[off.sum()], *(np.bincount(k, weights=off, minlength=BINS) for k in f), moved.ravel() - seen])
        grad = grad / toxic + ridge * x
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        x = x - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return x[:size], x[size:].reshape(2, 2)


def evidence(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: 1, the TOP highest log odds of its tokens, the log of its length."""
    size = np.diff(offsets)
    out = np.full((len(size), TOP + 2), -BOUND)
    out[:, 0], out[:, -1] = 1, np.log1p(size)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    p = np.clip(p, 1e-9, 1 - 1e-9)
    odds = np.clip(np.log(p / (1 - p)), -BOUND, BOUND)
    owner = np.repeat(np.arange(len(full)), size[full])
    for k in range(1, TOP + 1):
        most = np.maximum.reduceat(odds, offsets[full])
        out[full, k] = np.maximum(most, -BOUND)
        at = np.flatnonzero(odds == most[owner])
        odds[at[np.append(True, owner[at[1:]] != owner[at[:-1]])]] = -np.inf
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
    return w


def _sampled(rows: DataFrame, lexicons: dict[int, dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets, labels) of rows (i, t, l): tasks turn the texts into
    four small numbers a token, the driver gets those alone."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches):
        for batch in batches:
            label = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
            at = 0
            for run in pieces(plain(batch.column(1))):
                codes, distinct, offsets = words(run)
                kind = label[at : at + len(run)]
                own = [np.stack(features(bins_of(distinct, shared.value[k]), codes, offsets), axis=1).astype(np.uint8) for k in (0, 1)]
                found = [own[k][offsets[j] : offsets[j + 1]].tobytes() for j, k in enumerate(kind.tolist())]
                yield pa.record_batch([batch.column(0).slice(at, len(run)), pa.array(kind), pa.array(found, pa.binary())], names=["i", "l", "f"])
                at += len(run)

    table = rows.select("i", "t", "l").mapInArrow(work, "i bigint, l bigint, f binary").orderBy("i").toArrow()
    own = table["f"].to_pylist()
    flat = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 4).astype(np.int64)
    return flat.T, np.concatenate(([0], np.cumsum([len(x) // 4 for x in own]))).astype(np.int64), table["l"].to_numpy().astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Field | None:
    """The field, or None where no row or one kind of row teaches.

    Word counts cover every labelled row, whatever its length.  The field and
    the final scale are fitted to at most MOST_ROWS rows of each kind, those of
    the smallest hash of ``id_col``; the scale weighs them so that the kinds
    are as frequent as among all rows.  The lexicon is broadcast; it holds what
    the interval of the log odds tells from chance, and nothing else.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("l"))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    same = texts.select("i", F.xxhash64("t").alias("h")).join(marked, "i")
    kept = written(same.groupBy("h", "l").agg(F.min("i").alias("i")).select("i", "l"), "labelled")
    rows = texts.join(kept, "i")
    kinds = {r["l"]: r["n"] for r in kept.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not (kinds.get(0) and kinds.get(1)):
        return None
    odds = log_odds(F.col("toxic"), F.col("other"), kinds)
    found = text_counts(rows, "t", "l").where(odds >= float(EDGES[0]))
    without = {2: odds, 1: log_odds(F.col("toxic") - 1, F.col("other"), kinds), 0: log_odds(F.col("toxic"), F.greatest(F.col("other") - 1, F.lit(0)), kinds)}
    best = sorted(found.select("word", *(o.alias(f"o{k}") for k, o in without.items())).collect(), key=lambda r: r["word"])
    lexicons = {k: {r["word"]: int(np.searchsorted(EDGES, r[f"o{k}"], side="right")) for r in best} for k in without}
    ids = [kept.where(F.col("l") == k).orderBy(F.xxhash64("i"), "i").limit(MOST_ROWS) for k in (0, 1)]
    chosen = ids[0].unionByName(ids[1])  # at most 2 * MOST_ROWS rows
    f, offsets, label = _sampled(rows.drop("l").join(F.broadcast(chosen), "i"), lexicons)
    if not f.shape[1]:
        return None
    state = ((np.maximum(f[0], f[1]) > 0) & (np.repeat(label, np.diff(offsets)) == 1)).astype(np.int64)
    weights, steps = _fit(tuple(f), offsets, state)
    p, _, _ = marginals(_scores(weights, f), steps, offsets)
    share = np.array([kinds[k] / max(1, int((label == k).sum())) for k in (0, 1)])
    return Field(lexicons[2], weights, steps, _logistic(evidence(p, offsets), label, share[label]))


def scored(docs: DataFrame, model: Field | None, text_col: str = "text", into: str = "toxicity", spans: bool = False, least: float = 0.5) -> DataFrame:
    """``docs`` with a struct column ``into``: the score and, where asked for,
    the spans (code points, ends exclusive) of tokens of probability ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("score", pa.float64())] + [("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] * spans
    kind = pa.struct(fields)

    def work(run: pa.Array) -> pa.Array:
        model = shared.value
        if model is None:
            columns = [np.zeros(len(run))]
            found = [[] for _ in range(len(run))]
        else:
            codes, distinct, offsets = words(run)
            f = features(bins_of(distinct, model.lexicon), codes, offsets)
            p, _, _ = marginals(_scores(model.weights, f), model.steps, offsets)
            columns = [1 / (1 + np.exp(-np.clip(evidence(p, offsets) @ model.scale, -30, 30)))]
            found = token_spans(run, p >= least, offsets) if spans else []
        parts = [pa.array(columns[0])] + [pa.array(found, fields[1][1])] * spans if spans else [pa.array(columns[0])]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    @F.arrow_udf("score double" + ", spans array<struct<start: int, end: int>>" * spans)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, work, kind, 2 << 20)

    return docs.withColumn(into, run(F.col(text_col)))


def token_spans(texts: pa.Array, toxic: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Where the toxic tokens of each text stand; neighbours make one span."""
    import re

    from .textbatch import SPACES

    cut, out = re.compile(f"[^{SPACES}]+"), []
    for i in range(len(texts)):
        own, spans, last = toxic[offsets[i] : offsets[i + 1]], [], -2
        if own.any():
            for k, m in enumerate(cut.finditer(texts[i].as_py())):
                if own[k]:
                    if last == k - 1:
                        spans[-1]["end"] = m.end()
                    else:
                        spans.append({"start": m.start(), "end": m.end()})
                    last = k
        out.append(spans)
    return out
