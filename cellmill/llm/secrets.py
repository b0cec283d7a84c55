"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton of all rules' keywords runs once over a text whose
ASCII letters are lower-cased.  A rule's expression is tried only at the hits
of its keywords, anchored there.  Runs of hexadecimal digits have no keyword;
one expression over the whole text finds them.  Tokens that carry their own
checksum (a CRC-32 in base 62 at the end of hosting and package-registry
tokens, the Luhn digit of payment cards) are reported only if it holds.

Edge cases: a null text is the empty text and has no spans; spans count code
points, ends exclusive; a text of any length is scanned whole; repeated rows
give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import in_pieces

# The kinds and their patterns.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SIGNED = re.compile(r"(?:gh[opsur]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
SIGNED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CARD = re.compile(r"(?<![0-9])[0-9]{16}(?![0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: All kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "signed", "card")
BASE_KINDS = KINDS[:3]


def checksum62(text: str) -> str:
    """The CRC-32 of ``text`` in six base-62 digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def keyword_automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, keywords in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("signed", SIGNED_WORDS)):
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_AUTOMATON: list[ahocorasick.Automaton] = []


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then by kind.

    Within a kind, matches are leftmost and don't overlap, as if its pattern
    ran over the whole text; matches that are too short, or whose checksum
    fails, are left out but still hide what lies under them.
    """
    if not _AUTOMATON:
        _AUTOMATON.append(keyword_automaton())
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    near: dict[str, list[int]] = {"assign": [], "access": [], "signed": []}
    for end, (kind, size) in _AUTOMATON[0].iter(lowered):
        near[kind].append(end - size + 1)
    spans = []
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("signed", SIGNED)):
        free = 0
        for at in sorted(near[kind]):
            if at < free or not (m := pattern.match(text, at)):
                continue
            free = m.end()
            if kind == "assign" and len(m[2]) < 12 or kind == "access" and free - at < 18:
                continue
            if kind == "signed" and checksum62(m[1]) != m[2]:
                continue
            spans.append((at, kind, free))
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if luhn(m[0]) and m[0].strip("0")]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> of the secrets in each text."""

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(run: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": k} for a, k, b in find(x)] for x in run.to_pylist()], kind)

    @F.arrow_udf("array<struct<start: int, end: int, kind: string>>")
    def run(text: pa.Array) -> pa.Array:
        return in_pieces(text, work, kind)

    return run(text)


def redacted(text: Column) -> Column:
    """Each text with every secret replaced by ``[KIND]``; null for null."""

    def hide(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, kind, end in find(text):
            if end > at:
                out += [text[at : max(at, start)], f"[{kind.upper()}]" if start >= at else ""]
                at = end
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([hide(x) for x in text.to_pylist()], pa.string())

    return run(text)


def scanned(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``into``: counts of the base kinds, the
    SHA-256 of the base spans' listing, and the listing of all spans."""
    kind = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def told(text: str) -> dict:
        spans = find(text)
        base = [s for s in spans if s[1] in BASE_KINDS]
        counts = {f"n_{k}": sum(s[1] == k for s in base) for k in BASE_KINDS}
        return counts | {"base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(spans)}

    @F.arrow_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def run(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda x: pa.array(map(told, x.to_pylist()), kind), kind)

    return docs.withColumn(into, run(F.col(text_col)))
