"""Token ids in files of fixed-width bits.

Each id takes the fewest bits that hold every id of the vocabulary.  A file is

    magic, then the blocks, each of BLOCK ids packed and padded to a byte;
    the offset of each block and of the end of the last (int64);
    doc_id (int64), whether it is null (int8), first id (int64) and number of
    ids (int64) of each document;
    a footer of int64: bits, block size, ids, blocks, documents; then magic.

Documents are ordered by id over all files (nulls first), files by their
number.  A reader unpacks any run of ids from the blocks that hold it.

Edge cases: a null text has only the end id; equal ids keep all their rows;
no row gives no file; texts of any length are encoded whole, by the
tokenizers library, each distinct word of a batch once.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Runs, Splitter, shared_vocabulary
from .files import made_folder, opened, read_range
from .scratch import new_dir, written
from .textbatch import gathered, pieces, plain, words

MAGIC = b"CMIDS001"
BLOCK = 4096
#: Words and pre-tokens that a worker remembers, about; beyond it, it starts
#: anew.  Words are cheap to cut again, pre-tokens cost a call of the library.
MOST_WORDS, MOST_TOKENS = 200_000, 400_000


def bits_for(size: int) -> int:
    return max(1, int(size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, the lowest bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None] >> np.arange(bits)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """One file, written block by block as ids come."""

    def __init__(self, uri: str, bits: int):
        system, path = opened(uri)
        self.out, self.bits = system.open_output_stream(path), bits
        self.out.write(MAGIC)
        self.rest, self.offsets = np.zeros(0, np.int64), [len(MAGIC)]
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, sizes))
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            self._block(ids[at : at + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> int:
        if len(self.rest):
            self._block(self.rest)
        doc_ids, nulls, sizes = (np.concatenate([x[k] for x in self.docs]) for k in range(3))
        for part, kind in ((self.offsets, "<i8"), (doc_ids, "<i8"), (nulls, "i1"), (np.cumsum(sizes) - sizes, "<i8"), (sizes, "<i8"), ([self.bits, BLOCK, self.ids, len(self.offsets) - 1, len(sizes)], "<i8")):
            self.out.write(np.asarray(part).astype(kind).tobytes())
        self.out.write(MAGIC)
        self.out.close()
        return len(sizes)


class Reader:
    """Random access to a file: its index is read at once, ids by request."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = opened(uri)
        size = system.get_file_info(path).size
        tail = read_range(uri, size - 40 - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} isn't a file of packed ids")
        self.bits, self.block, self.ids, blocks, docs = np.frombuffer(tail[:40], "<i8").tolist()
        index = read_range(uri, size - 40 - len(MAGIC) - 8 * (blocks + 1) - 25 * docs, size - 40 - len(MAGIC))
        self.offsets = np.frombuffer(index, "<i8", blocks + 1)
        at = 8 * (blocks + 1)
        self.doc_ids, self.nulls = np.frombuffer(index, "<i8", docs, at), np.frombuffer(index, "i1", docs, at + 8 * docs)
        self.first, self.sizes = np.frombuffer(index, "<i8", docs, at + 9 * docs), np.frombuffer(index, "<i8", docs, at + 17 * docs)

    def run(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the one numbered ``start`` on."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block
        data = read_range(self.uri, int(self.offsets[a]), int(self.offsets[b + 1]))
        base, out = int(self.offsets[a]), []
        for k in range(a, b + 1):
            part = data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]
            out.append(unpacked(part, min(self.block, self.ids - k * self.block), self.bits))
        return np.concatenate(out)[start - a * self.block :][:n]

    def document(self, i: int) -> np.ndarray:
        return self.run(int(self.first[i]), int(self.sizes[i]))


def eased(texts: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer distinct words: A to Z in lower case, and
    a blank before punctuation that ends a word, where the splitter cuts anyway.
    Texts with combining marks or special tokens stay as they are."""
    if pc.any(pc.match_substring_regex(texts, r"\p{M}")).as_py() or pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([\p{L}\p{N}])([.,;:?]+)(\s|$)", r"\1 \2\3")


class Encoder:
    """The tokenizers library, asked once for each distinct pre-token.

    The vocabulary's normalizer and splitter never look across white space, so
    a text's ids are those of its words, and a word's those of its pre-tokens.
    Each pre-token's last id, and no other, is of a token with the suffix that
    ends words; so many pre-tokens go through the library as one line.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.splitter = Splitter(json.loads(vocabulary))
        self.ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith(self.splitter.suffix) or token in self.splitter.special
        self.words, self.tokens = Runs(), Runs()

    def _asked(self, tokens: list[str]) -> None:
        """Learn the ids of new pre-tokens."""
        for at in range(0, len(tokens), 8192):
            some = tokens[at : at + 8192]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):  # not one run a pre-token: each by itself
                each = [x.ids for x in self.library.encode_batch_fast(some, add_special_tokens=False)]
                ids, last = np.array([i for x in each for i in x], np.int64), np.cumsum([len(x) for x in each]) - 1
            self.tokens.add(some, ids, np.diff(last, prepend=-1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        codes, distinct, offsets = words(eased(texts))
        named = distinct.to_pylist()
        if len(self.words.known) > MOST_WORDS:
            self.words = Runs()
        if len(self.tokens.known) > MOST_TOKENS:
            self.tokens = Runs()
        if new := [x for x in named if x and x not in self.words.known]:
            split = [self.splitter.split(x) for x in new]
            flat = [x for parts in split for x in parts]
            self._asked([x for x in dict.fromkeys(flat) if x not in self.tokens.known])
            ids, size = self.tokens.runs(self.tokens.places(flat))
            ends = np.concatenate(([0], np.cumsum(size)))
            stop = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            self.words.add(new, ids, np.diff(ends[stop], prepend=0))
        ids, size = self.words.runs(self.words.places(named)[codes])
        return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[offsets])


_MADE: dict[str, Encoder] = {}


def worker_encoder(vocabulary: str) -> Encoder:
    key = str(zlib.crc32(vocabulary.encode()))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(vocabulary)
    return _MADE[key]


FILES = "number int, path string, bits int, docs bigint, ids bigint"


def write(docs: DataFrame, vocabulary_path: str, folder: str | None = None, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, append ``end_id`` and write the files; a table of the files.

    Spark orders the documents by ranges of their ids, so a task writes one
    file of a run of documents and no task sees more than its run.
    """
    spark = docs.sparkSession
    folder = made_folder(folder or new_dir(spark, "ids"))
    vocabulary = shared_vocabulary(spark, vocabulary_path)

    def work(batches):
        from pyspark import TaskContext

        number, file, encoder = TaskContext.get().partitionId(), None, worker_encoder(vocabulary.value)
        for batch in batches:
            texts, at = plain(batch.column(1)), 0
            for run in pieces(texts, 6 << 20):
                if file is None:
                    path = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex}.bin"
                    file = Writer(path, bits_for(max(encoder.size, end_id + 1)))
                key = batch.column(0).slice(at, len(run))
                at += len(run)
                ids, sizes = encoder.encode(run)
                out = np.full(len(ids) + len(sizes), end_id, np.int64)
                out[gathered(np.cumsum(sizes + 1) - sizes - 1, sizes)] = ids
                file.add(pc.fill_null(key, 0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), out, sizes + 1)
        if file is not None:
            n = file.close()
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([path]), pa.array([file.bits], pa.int32()), pa.array([n], pa.int64()), pa.array([file.ids], pa.int64())], names=["number", "path", "bits", "docs", "ids"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange(parts, "i").sortWithinPartitions("i", F.xxhash64("t"))
    return written(ordered.mapInArrow(work, FILES), "id-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The table of files (a row a task that wrote) is small whatever the corpus;
    the driver adds up the ids before each file, tasks read the files.
    """
    spark = files.sparkSession
    listed = sorted(files.select("number", "path", "ids").collect())
    before = np.cumsum([0, *(r["ids"] for r in listed)]).tolist()
    if not listed:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = spark.createDataFrame([(r["path"], b) for r, b in zip(listed, before, strict=False)], "path string, before bigint").repartition(len(listed))

    def work(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                most = 1 << 20  # ids at a time; a longer document is read alone
                i = 0
                while i < len(file.sizes):
                    j = max(i + 1, int(np.searchsorted(file.first, file.first[i] + most)))
                    first, last = int(file.first[i]), int(file.first[j - 1] + file.sizes[j - 1])
                    raw = memoryview(file.run(first, last - first).astype("<u4").tobytes())
                    at = (4 * (file.first[i:j] - first)).tolist() + [4 * (last - first)]
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.record_batch(
                        [pa.array(file.doc_ids[i:j], mask=file.nulls[i:j].astype(bool)), pa.array(file.first[i:j] + base), pa.array(file.sizes[i:j]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    i = j

    return rows.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
