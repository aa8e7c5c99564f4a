"""Byte-range sources: local files, URLs and a cache over either."""

from __future__ import annotations

import io
import os
import urllib.request
from typing import Protocol

from ..errors import FormatError, QueryError


class ByteSource(Protocol):
    size: int

    def slice(self, start: int, end: int | None = None) -> bytes: ...


def _range(size: int, start: int, end: int | None) -> tuple[int, int]:
    """Absolute bounds; a negative start counts from the end."""
    if start < 0:
        if end is not None:
            raise QueryError(f"invalid suffix range [{start}, {end})")
        return max(0, size + start), size
    if end is not None and end < start:
        raise QueryError(f"invalid empty range [{start}, {end})")
    return start, size if end is None else min(end, size)


class FileSource:
    """A local file; slices exclude their end."""

    def __init__(self, path: str):
        self.path, self.size = path, os.stat(path).st_size

    def slice(self, start: int, end: int | None = None) -> bytes:
        start, end = _range(self.size, start, end)
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(end - start)


class MemorySource:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def slice(self, start: int, end: int | None = None) -> bytes:
        start, end = _range(self.size, start, end)
        return self.data[start:end]


def _open(url: str, headers: dict | None, method: str = "GET"):
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}, method=method))


def url_size(url: str, headers: dict | None = None) -> int:
    """Bytes of a URL's content: by HEAD, or where that is forbidden or silent by a one-byte range."""
    try:
        with _open(url, headers, "HEAD") as answer:
            if (length := answer.headers.get("Content-Length")) is not None:
                return int(length)
    except urllib.error.HTTPError as e:
        if e.code != 403:
            raise QueryError(f"fetch head failed {e.code}") from e
    with _open(url, {**(headers or {}), "Range": "bytes=0-0"}) as answer:
        if answer.status == 206 and (part := answer.headers.get("Content-Range")):
            return int(part.rpartition("/")[2])
        if (length := answer.headers.get("Content-Length")) is not None:
            return int(length)
    raise QueryError("missing content length")


class UrlSource:
    """A URL read by ranges; a server that sends the whole instead is asked once only."""

    def __init__(self, url: str, size: int | None = None, headers: dict | None = None):
        self.url, self.headers = url, headers
        self.size = url_size(url, headers) if size is None else size
        self._whole: bytes | None = None

    def slice(self, start: int, end: int | None = None) -> bytes:
        start, end = _range(self.size, start, end)
        if self._whole is None:
            with _open(self.url, {**(self.headers or {}), "Range": f"bytes={start}-{end - 1}"}) as answer:
                body = answer.read()
                if answer.status == 206:
                    return body
                if answer.status != 200:
                    raise QueryError(f"fetch failed {answer.status}")
                self._whole = body
        return self._whole[start:end]


class CachedSource:
    """Keeps a small source whole, and of a large one every range asked for."""

    def __init__(self, source: ByteSource, whole_below: int = 512 * 1024):
        self.source, self.size = source, source.size
        self._whole = source.slice(0, source.size) if source.size <= whole_below else None
        self._kept: dict[tuple[int, int], bytes] = {}

    def slice(self, start: int, end: int | None = None) -> bytes:
        key = _range(self.size, start, end)
        if self._whole is not None:
            return self._whole[slice(*key)]
        if key not in self._kept:
            self._kept[key] = self.source.slice(*key)
        return self._kept[key]


class SourceFile(io.RawIOBase):
    """A byte source as a seekable file, so that readers of files fetch the ranges that they need."""

    def __init__(self, source: ByteSource):
        self.source, self.at = source, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.source.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        end = min(self.at + len(buffer), self.source.size)
        data = self.source.slice(self.at, end) if end > self.at else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def footer_only(source: ByteSource, guess: int = 512 * 1024) -> bytes:
    """A Parquet file that has the footer of ``source`` and no data, from one range, or two where the footer is long."""
    tail = source.slice(max(0, source.size - guess))
    if source.size < 12:
        raise FormatError("parquet file is too short")
    if tail[-4:] != b"PAR1":
        raise FormatError("parquet file invalid (footer != PAR1)")
    length = int.from_bytes(tail[-8:-4], "little")
    if length > source.size - 12:
        raise FormatError(f"parquet metadata length {length} exceeds available buffer {source.size - 8}")
    if length + 8 > len(tail):
        tail = source.slice(source.size - length - 8)
    return b"PAR1" + tail[-length - 8 :]
