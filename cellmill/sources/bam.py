"""Alignment records in BAM files, written and read by many tasks (SRC12).

A BAM file is a chain of small gzip members (BGZF blocks), whose content is a
header and records that may cross blocks.  A reader's task gets a byte range:
it looks for a block whose successors are blocks too, then for a record whose
successors are records too, and owns the records that start in blocks of its
range, wherever they end.  So ranges can be cut anywhere.

Tags CB and UB (cell and molecule) are null where a record lacks them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder, stored

# fixed values of the format
MAGIC, BASES, BLOCK_END = b"BAM\1", "=ACMGRSVTWYHKDBN", 65_280
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Blocks and records that must follow one another before a guess is believed.
BLOCKS_SEEN, RECORDS_SEEN = 3, 5
LARGEST_RECORD = 1 << 28

READ = "query_name string, flag int, ref string, pos int, mapq int, seq string, cb string, ub string"
_CODE = {b: i for i, b in enumerate(BASES)}
_FIXED = struct.Struct("<iiiBBHHHiiii")  # size, reference, position, name length, quality, bin, cigar, flag, bases, mate's reference and position, template


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(row: dict, refs: dict[str, int]) -> bytes:
    name, seq = row["query_name"].encode() + b"\0", row["seq"] or ""
    codes = [_CODE.get(b, 15) for b in seq] + [0]
    bases = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    tags = b"".join(t + b"Z" + row[c].encode() + b"\0" for t, c in ((b"CB", "cb"), (b"UB", "ub")) if row[c] is not None)
    body = name + bases + b"\xff" * len(seq) + tags
    pos = -1 if row["pos"] is None else row["pos"]
    return _FIXED.pack(32 + len(body), refs.get(row["ref"], -1), pos, len(name), row["mapq"] or 0, 0, 0, row["flag"] or 0, len(seq), -1, -1, 0) + body


def write(reads: DataFrame, references: list[tuple[str, int]], folder: str | None = None) -> DataFrame:
    """path and bytes of the files, one a task, of ``reads`` (the columns of READ).
    ``references``: name and length of each sequence."""
    folder = folder or new_folder(reads.sparkSession, "bam")
    names = {n: i for i, (n, _) in enumerate(references)}

    def work(batches):
        head = MAGIC + struct.pack("<i", 0) + struct.pack("<i", len(references))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
        out, path, total = None, f"{folder}/{uuid.uuid4().hex}.bam", 0
        rest = bytearray(head)

        def flush(all_: bool):
            nonlocal total
            while len(rest) >= BLOCK_END or all_ and rest:
                data = _block(bytes(rest[:BLOCK_END]))
                out.write(data)
                total += len(data)
                del rest[:BLOCK_END]

        for batch in batches:
            if out is None:
                system, place = _opened(path)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(place)
            for row in batch.to_pylist():
                rest += _record(row, names)
                flush(False)
        if out is not None:
            flush(True)
            out.write(EOF)
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([total + len(EOF)])], names=["path", "bytes"])

    columns = [c.split()[0] for c in READ.split(", ")]
    return stored(reads.select(*columns).mapInArrow(work, "path string, bytes bigint"), "bam-files")


class _File:
    """A file's blocks by offset, a window of bytes at a time."""

    def __init__(self, uri: str, window: int = 1 << 20):
        system, path = _opened(uri)
        self.file, self.size, self.window = system.open_input_file(path), system.get_file_info(path).size, window
        self.start, self.data = 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, self.window))
        return self.data[at - self.start : at - self.start + n]

    def block_size(self, at: int) -> int:
        """Bytes of the block that starts there, 0 if none does."""
        head = self.bytes_at(at, 12)
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra = self.bytes_at(at + 12, struct.unpack("<H", head[10:])[0])
        k = 0
        while k + 4 <= len(extra):
            size = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and size == 2 and k + 6 <= len(extra):
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + size
        return 0

    def first_block(self, start: int) -> int:
        """Offset of the first block from ``start`` on, the file's end if there is none."""
        at = start
        while at < self.size:
            near = self.bytes_at(at, min(self.window, self.size - at))
            k = near.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                at += max(1, len(near) - 3)
                continue
            at += k
            here = at
            for _ in range(BLOCKS_SEEN):
                size = self.block_size(here)
                here += size
                if not size or here >= self.size:
                    break
            if size and here <= self.size:
                return at
            at += 1
        return self.size

    def blocks(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(offset, content) of the blocks from one on."""
        while at < self.size:
            size = self.block_size(at)
            if not size:
                raise ValueError(f"no block at {at}")
            raw = self.bytes_at(at, size)
            extra = struct.unpack_from("<H", raw, 10)[0]
            yield at, zlib.decompress(raw[12 + extra : -8], -15)
            at += size


class _Stream:
    """The content of a chain of blocks, and in which block a place lies."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.next, self.data, self.marks, self.gone = blocks, bytearray(), [], 0

    def has(self, place: int, n: int) -> bool:
        """Whether ``n`` bytes lie from ``place`` on, which reads as many blocks."""
        while place + n > self.gone + len(self.data):
            block = next(self.next, None)
            if block is None:
                return False
            self.marks.append((self.gone + len(self.data), block[0]))
            self.data += block[1]
        return True

    def take(self, place: int, n: int) -> bytes:
        return bytes(self.data[place - self.gone : place - self.gone + n])

    def block_of(self, place: int) -> int:
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.pop(0)
        return self.marks[0][1]

    def forget(self, place: int) -> None:
        if place - self.gone > 1 << 20:
            del self.data[: place - self.gone]
            self.gone = place


def _header(stream: _Stream) -> tuple[list[str], int]:
    """(names of the references, where the records begin)"""
    number: callable = lambda at: struct.unpack("<i", stream.take(at, 4))[0] if stream.has(at, 4) else 0
    if not stream.has(0, 8) or stream.take(0, 4) != MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    names, at = [None] * number(at), at + 4
    for k in range(len(names)):
        n = number(at)
        stream.has(at + 4, n + 4)
        names[k], at = stream.take(at + 4, n - 1).decode(), at + 8 + n
    return names, at


def _plausible(stream: _Stream, at: int, refs: int) -> int:
    """The size of the record that may start there, 0 if none can."""
    if not stream.has(at, 36):
        return 0
    size, ref, pos, name, _, _, cigar, _, bases, mate, mate_pos, _ = _FIXED.unpack(stream.take(at, 36))
    least = 32 + name + 4 * cigar + (bases + 1) // 2 + bases
    if not (0 <= bases and name and least <= size <= LARGEST_RECORD and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1):
        return 0
    if not stream.has(at + 36, name) or stream.take(at + 36, name).find(b"\0") != name - 1:
        return 0
    return 4 + size


def _first_record(stream: _Stream, refs: int, place: int = 0) -> int | None:
    """Where the first record starts, if any does before the content ends."""
    while stream.has(place, 36):
        at = place
        for _ in range(RECORDS_SEEN):
            size = _plausible(stream, at, refs)
            if not size:
                break
            at += size
            if not stream.has(at, 1):  # the last record
                size = size if stream.has(at - 1, 1) else 0
                break
        if size:
            return place
        place += 1
    return None


def _tags(raw: bytes) -> dict[str, str]:
    """The text tags of a record, other kinds skipped."""
    sizes, out, at = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}, {}, 0
    while at + 3 <= len(raw):
        tag, kind, at = raw[at : at + 2].decode("latin-1"), raw[at + 2 : at + 3], at + 3
        if kind in (b"Z", b"H"):
            end = raw.index(b"\0", at)
            out[tag], at = raw[at:end].decode(), end + 1
        elif kind == b"B":
            at += 5 + sizes[raw[at : at + 1]] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += sizes[kind]
    return out


def _parsed(raw: bytes, names: list[str]) -> tuple:
    _, ref, pos, name, quality, _, cigar, flag, bases, _, _, _ = _FIXED.unpack_from(raw)
    at = 36 + name + 4 * cigar
    pairs = raw[at : at + (bases + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in pairs)[:bases]
    tags = _tags(raw[at + (bases + 1) // 2 + bases :])
    return raw[36 : 35 + name].decode(), flag, names[ref] if ref >= 0 else None, pos if pos >= 0 else None, quality, seq, tags.get("CB"), tags.get("UB")


def records(uri: str, start: int, stop: int) -> Iterator[tuple]:
    """The records that start in blocks from ``start`` to before ``stop``."""
    file = _File(uri)
    names, place = _header(_Stream(_File(uri).blocks(0)))
    first = file.first_block(start)
    if first >= stop:
        return
    stream = _Stream(file.blocks(first))
    at = place if first == 0 else _first_record(stream, len(names))
    while at is not None and stream.has(at, 36) and stream.block_of(at) < stop:
        n = 4 + struct.unpack("<i", stream.take(at, 4))[0]
        if not stream.has(at, n):
            raise ValueError(f"{uri} ends inside a record")
        yield _parsed(stream.take(at, n), names)
        at += n
        stream.forget(at)


def read(spark: SparkSession, files: DataFrame, split: int = 64 << 20) -> DataFrame:
    """The records of ``files`` (path, bytes), a task a range of ``split`` bytes."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    many = max(1, ranges.count())

    def work(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in READ.split(", ")]
        some: list[tuple] = []
        pack: callable = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for row in batch.to_pylist():
                for record in records(row["path"], row["start"], row["start"] + split):
                    some.append(record)
                    if len(some) == 4096:
                        yield pack()
                        some = []
        if some:
            yield pack()

    return ranges.repartition(many, "path", "start").mapInArrow(work, READ)
