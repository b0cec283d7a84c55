"""Byte-pair encoding and decoding with numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up the rank of
every adjacent pair by binary search over the sorted pair keys, takes the
lowest rank of each word and merges all its places at once; a word leaves when
none of its pairs has a rank.  Only distinct words of a batch go through the
rounds, and a worker keeps a bounded table of the words it has met.

Edge cases: a null text is the empty text and has no ids; special tokens in a
text become their ids, as in the tokenizers library; repeated rows and ties
need nothing, since a text's result depends on that text alone; an empty table
gives an empty table; columns beside the text pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import gathered, in_pieces, words

#: Words or pre-tokens that a worker remembers at most; beyond it, it starts anew.
REMEMBERED = 200_000
NONE = np.iinfo(np.int64).max


class Splitter:
    """Words to pre-tokens, as the vocabulary's normalizer and splitter say."""

    def __init__(self, told: dict):
        self.suffix = told["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.parts = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def split(self, word: str) -> list[str]:
        """The pre-tokens of a word; special tokens as they are."""
        if "<" in word and self.marks.search(word):
            out, at = [], 0
            for m in self.marks.finditer(word):
                out += [*self._plain(word[at : m.start()]), m[0]]
                at = m.end()
            return out + self._plain(word[at:])
        return self._plain(word)

    def _plain(self, word: str) -> list[str]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if "Σ" in word:  # lower case goes character by character
                word = "".join(c.lower() for c in word)
        word = word.lower()
        return [word] if word.isalpha() else self.parts.findall(word)


class Runs:
    """Runs of ids by name."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat, self.start, self.count = (np.zeros(0, np.int32) for _ in range(3))

    def add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.start = np.append(self.start, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32))
        self.count = np.append(self.count, counts.astype(np.int32))
        self.flat = np.append(self.flat, ids.astype(np.int32))

    def places(self, names: list[str]) -> np.ndarray:
        return np.fromiter((self.known.get(x, 0) for x in names), np.int32, len(names))

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.count):
            return np.zeros(0, np.int32), np.zeros(len(places), np.int64)
        size = self.count[places].astype(np.int64)
        return self.flat[gathered(self.start[places], size)], size


class WordBPE:
    """Ids of texts by a vocabulary whose words end in a suffix (``</w>``)."""

    def __init__(self, vocabulary: str):
        told = json.loads(vocabulary)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.splitter = Splitter(told)
        self.size = 1 + max([*self.vocab.values(), *self.splitter.special.values()])
        names = [""] * self.size
        for name, i in [*self.vocab.items(), *self.splitter.special.items()]:
            names[i] = name
        self.names = pa.array(names, pa.large_string())
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        key = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        shown = _shown_bytes()
        self.inner = np.array([self.vocab[c] for c in shown], np.int64)
        self.final = np.array([self.vocab[c + self.splitter.suffix] for c in shown], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.words, self.tokens = Runs(), Runs()
        special = self.splitter.special
        self.tokens.add(list(special), np.array(list(special.values()), np.int64), np.ones(len(special), np.int64))

    def _rounds(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens one after the other, and how many each has."""
        coded = [x.encode() for x in tokens]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        out_ids, out_owner = [], []
        rank = self._rank(symbols[:-1], symbols[1:])
        rank = np.append(rank, NONE) if len(symbols) else rank
        rank[ends - 1] = NONE
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            runs = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best != NONE, runs)
            if not live.all():
                out_ids.append(symbols[~live])
                out_owner.append(owner[~live])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                keep = best != NONE
                best, runs = best[keep], runs[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, runs))
            touching = np.append(False, at[1:] == at[:-1] + 1)
            if touching.any():  # a a a: from the left, pairs don't overlap
                head = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            for i in (new[new > 0] - 1, new):
                j = np.minimum(i + 1, len(symbols) - 1)
                rank[i] = np.where((owner[i] == owner[j]) & (i != j), self._rank(symbols[i], symbols[j]), NONE)
        ids = np.concatenate(out_ids) if out_ids else np.zeros(0, np.int64)
        whose = np.concatenate(out_owner) if out_owner else np.zeros(0, np.int64)
        return ids[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(tokens)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin."""
        codes, distinct, offsets = words(texts)
        named = distinct.to_pylist()
        if len(self.words.known) > REMEMBERED or len(self.tokens.known) > REMEMBERED:
            self._forget()
        if new := [x for x in named if x and x not in self.words.known]:
            split = [self.splitter.split(x) for x in new]
            flat = [x for parts in split for x in parts]
            if tokens := [x for x in dict.fromkeys(flat) if x not in self.tokens.known]:
                self.tokens.add(tokens, *self._rounds(tokens))
            ids, size = self.tokens.runs(self.tokens.places(flat))
            ends = np.concatenate(([0], np.cumsum(size)))
            stop = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            self.words.add(new, ids, np.diff(ends[stop], prepend=0))
        ids, size = self.words.runs(self.words.places(named)[codes])
        return ids, np.concatenate(([0], np.cumsum(size)))[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """What the ids stand for, joined as the library's decode() does
        where the vocabulary names no decoder: with a space between tokens."""
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.names.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _shown_bytes() -> list[str]:
    """The character that a byte-level vocabulary shows for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_MADE: dict[int, WordBPE] = {}


def worker_bpe(broadcast) -> WordBPE:
    """The encoder of this worker process, made once."""
    key = broadcast.id if hasattr(broadcast, "id") else hash(broadcast.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = WordBPE(broadcast.value)
    return _MADE[key]


def shared_vocabulary(spark, path: str):
    """The vocabulary file (a few MB, whatever the corpus) for all executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(texts: Column, vocabulary) -> Column:
    """array<int> of ids of each text; ``vocabulary`` is from :func:`shared_vocabulary`."""

    def work(run: pa.Array) -> pa.Array:
        ids, offsets = worker_bpe(vocabulary).encode(run)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, work, pa.list_(pa.int32()))

    return run(texts)


def decoded(ids: Column, vocabulary) -> Column:
    """The text of each array of ids; null for null."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        text = worker_bpe(vocabulary).decode(ids.flatten().to_numpy(zero_copy_only=False), offsets)
        return pc.if_else(ids.is_null(), pa.scalar(None, text.type), text).cast(pa.string())

    return run(ids)


def tokenised(docs: DataFrame, vocabulary_path: str, text_col: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``into``: the ids of each text and the text
    decoded from them, in one pass."""
    vocabulary = shared_vocabulary(docs.sparkSession, vocabulary_path)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def work(run: pa.Array) -> pa.Array:
        bpe = worker_bpe(vocabulary)
        ids, offsets = bpe.encode(run)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.StructArray.from_arrays([lists, bpe.decode(ids, offsets).cast(pa.string())], fields=list(kind))

    @F.arrow_udf("ids array<int>, decoded string")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, work, kind)

    return docs.withColumn(into, run(F.col(text_col)))


ROUND_TRIP = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary_path: str, text_col: str = "text", into: str = "bpe") -> DataFrame:
    """``docs`` with a struct column ``into``: the number of ids of the text,
    the SHA-256 of the ids as little-endian 32-bit integers, and that of the
    text decoded from them.  Encodes and decodes every text whole in one pass,
    without a shuffle."""
    vocabulary = shared_vocabulary(docs.sparkSession, vocabulary_path)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(run: pa.Array) -> pa.Array:
        bpe = worker_bpe(vocabulary)
        ids, offsets = bpe.encode(run)
        raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        texts = bpe.decode(ids, offsets)
        raw = memoryview(texts.buffers()[2] or b"")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset).tolist()
        again = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array(again, pa.string())], fields=list(kind))

    @F.arrow_udf(ROUND_TRIP)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, work, kind)

    return docs.withColumn(into, run(F.col(text_col)))
