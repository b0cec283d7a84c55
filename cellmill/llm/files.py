"""Files that tasks write and read by themselves, through the file systems
that Arrow knows.

A task writes under a name that no other attempt uses and reports it in its
rows.  Only reported files count, so a lost executor, a second attempt or a
speculative one leaves at most files that nobody reads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def made_folder(uri: str) -> str:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    return uri


def read_range(uri: str, start: int, stop: int | None = None) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read() if stop is None else f.read(stop - start)


def chunks(uri: str, start: int, size: int) -> Iterator[bytes]:
    """The bytes of a file from ``start`` on, in pieces."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        while data := f.read(size):
            yield data
