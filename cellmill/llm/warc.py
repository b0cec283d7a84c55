"""WARC archives: a writer with revisit records and a splittable reader.

A record is one gzip member of its own.  The reader deals byte ranges of the
archives to tasks.  A task looks for the magic of gzip in its range, decodes
the head of each candidate to see whether a WARC record begins there, and owns
the records that begin inside its range, reading past the range's end for the
rest of the last one.

Archives of other writers are read too: versions 1.0 and 1.1, every type of
record, one record a gzip member.  What their heads don't state is taken from
their blocks: the payload is what follows the HTTP head, where there is one.

Edge cases: a null payload is the empty payload; a null url is the empty url;
pages with a null id are archived and have a null id again; of equal ids each
row has its record, the payload's first one (by id, then by url) answers for
the others; no page gives no archive; payloads may have any length; a record that
names no page has a null page_id, a revisit that doesn't state its payload's
length a null one; a member that isn't a WARC record is passed over.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import chunks, made_folder, opened
from .scratch import new_dir, written

MAGIC = b"\x1f\x8b\x08"
VERSION, VERSIONS = b"WARC/1.1\r\n", (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
LEVEL = 4
FILES = "path string, bytes bigint, records bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"


def canonical(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """i, u, h (payload, bytes), d (digest) and r: the id of the response that
    the page revisits, or null.

    Only digests are grouped.  Digests that occur once need no partner, so the
    join brings the others alone to the pages: by broadcast while they are few,
    else by sending pages, payloads included, through one shuffle.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(url_col), F.lit("")).alias("u"), payload.alias("h")).withColumn("d", F.sha2("h", 256))
    key = F.struct(F.col("i").isNull().alias("n"), "i", "u")
    groups = own.where(F.length("h") >= least).groupBy("d").agg(F.min(key).alias("k"), F.count("*").alias("c")).where("c > 1").select("d", "k")
    joined = own.join(written(groups, "digests"), "d", "left")
    return joined.select("i", "u", "h", "d", F.when(F.col("k").isNotNull() & ~key.eqNullSafe(F.col("k")), F.col("k.i")).alias("r"), (F.col("k").isNotNull() & ~key.eqNullSafe(F.col("k"))).alias("v"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC record, not compressed."""
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record a page; a table of the archives."""
    folder = made_folder(folder or new_dir(pages.sparkSession, "warc"))

    def work(batches):
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for i, u, h, d, r, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, name = opened(path)
                    out = system.open_output_stream(name, compression=None)
                deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = deflate.compress(record(i, u, h, d, r, v)) + deflate.flush()
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return written(canonical(pages, id_col, url_col, html_col, least).mapInArrow(work, FILES), "warc-files")


def records_in(path: str, start: int, stop: int, buffer: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of the records that begin in bytes ``start`` to ``stop``."""
    source, data, base = chunks(path, start, buffer), bytearray(), start

    def more() -> bool:
        piece = next(source, b"")
        data.extend(piece)
        return bool(piece)

    at = 0
    while base + at < stop:
        if at > buffer:
            del data[:at]
            base, at = base + at, 0
        found = data.find(MAGIC, at)
        if found < 0:
            at = max(at, len(data) - len(MAGIC) + 1)
            if not more():
                return
            continue
        if base + found >= stop:
            return
        inflate, text, used, good, checked = zlib.decompressobj(31), bytearray(), found, True, False
        while good and not inflate.eof:
            if used >= len(data) and not more():
                good = False
                break
            try:
                text += inflate.decompress(bytes(data[used : used + buffer]))
            except zlib.error:
                good = False
                break
            used = min(len(data), used + buffer)
            if not checked and len(text) >= len(VERSION):
                checked, good = True, bytes(text[: len(VERSION)]) in VERSIONS
        if good and checked:
            at = used - len(inflate.unused_data)
            head, _, block = bytes(text).partition(b"\r\n\r\n")
            fields = _fields(head)
            size = fields.get("content-length", "")
            yield fields, block[: int(size)] if size.isdigit() else block.removesuffix(b"\r\n\r\n")
        else:
            at = found + 1


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by their names in lower case; folded lines are joined."""
    out, name = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.removeprefix("-").isdigit() else None


def _row(fields: dict[str, str], block: bytes, path: str, verify: bool) -> tuple:
    """The row of a record, as RECORD says."""
    kind, name, url = fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", "")
    if name.startswith("<urn:page:"):
        url = url.encode().decode("unicode_escape")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    stated, size = fields.get("warc-payload-digest", ""), fields.get("x-payload-length", "")
    mine = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
    if kind == "revisit":
        length, digest = int(size) if size.isdigit() else None, mine or stated or None
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest() if verify or not mine else mine
        if verify and ((mine and len(mine) == 64 and mine.lower() != digest) or (size.isdigit() and int(size) != length)):
            raise ValueError(f"{path}: a record's payload isn't what it states")
    return _page(name), url, length, digest, kind, _page(fields.get("warc-refers-to", "")), name


def read(archives: DataFrame, range_bytes: int = 8 << 20, verify: bool = True) -> DataFrame:
    """A row a record of the archives, as RECORD says.

    ``archives`` has columns path and bytes.  With ``verify``, the payload of
    every record with one is hashed again and must have the SHA-256 digest that
    the record states.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes)))
    ranges = archives.select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("bytes"), F.col("start") + range_bytes).alias("stop"))
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def work(batches):
        for batch in batches:
            for path, start, stop in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows = [_row(fields, block, path, verify) for fields, block in records_in(path, start, stop)]
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.repartition(tasks, "path", "start").mapInArrow(work, RECORD)
