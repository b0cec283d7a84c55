"""Vectorised handling of a batch of texts inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the tokenizers' regular expressions call white space (\s).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain(texts: pa.Array) -> pa.Array:
    """The texts with null as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def pieces(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``most_bytes``; a longer text is one run."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most_bytes:
            yield texts.slice(at, i - at)
            pa.default_memory_pool().release_unused()
            at, total = i, 0
        total += n
    if at < len(texts):
        yield texts.slice(at)


def in_pieces(texts: pa.Array, work: Callable[[pa.Array], pa.Array], kind: pa.DataType, most_bytes: int = 4 << 20) -> pa.Array:
    """``work`` over the runs of :func:`pieces`, put together again."""
    return pa.concat_arrays([pa.array([], kind), *(work(x).cast(kind) for x in pieces(plain(texts), most_bytes))])


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct, offsets): the words of text i, as cut at white space,
    are ``distinct[codes[offsets[i]:offsets[i + 1]]]``.

    White space is what :data:`SPACES` holds.  ``distinct`` may also hold an
    empty word that no code names.
    """
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # Arrow cuts at these, the tokenizers don't
        import re

        cut = re.compile(f"[^{SPACES}]+")
        parts = pa.array([cut.findall(x) for x in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        parts = pc.utf8_split_whitespace(texts)
    size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    coded = pc.dictionary_encode(parts.flatten())
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if (none := pc.index(distinct, pa.scalar("", distinct.type)).as_py()) >= 0:
        keep = codes != none
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return codes, distinct, offsets


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] : starts[i] + sizes[i]``, one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
