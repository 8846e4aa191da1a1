"""Files of mounted folders and of stores that pyarrow opens, read by ranges and written as streams."""

from __future__ import annotations

import re
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def _filesystem(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0] if root else fs.LocalFileSystem()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; without a scheme, or with that of files, it is a mounted folder."""
    path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        return _filesystem(""), path
    root = re.match("[^:]+://[^/]*", path)[0]
    return _filesystem(root), fs.FileSystem.from_uri(path)[1]


class Ranged:
    """A file of which ranges are read, or bytes at hand in its place."""

    def __init__(self, source: str | bytes):
        self._bytes = source if isinstance(source, bytes) else None
        if self._bytes is not None:
            self._file, self.size = None, len(source)
        else:
            store, path = located(source)
            self._file = store.open_input_file(path)
            self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on; fewer at the end of the file."""
        if self._bytes is not None:
            return self._bytes[at : at + n]
        n = min(n, self.size - at)
        return self._file.read_at(n, at) if n > 0 else b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        if self._file is not None:
            self._file.close()
