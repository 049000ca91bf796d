"""Files by URI on driver and executors, and what they hold by their first bytes."""

from __future__ import annotations

import zlib


def opened(path: str):
    """(file system, path in it). URIs are those that pyarrow.fs knows; others are local paths."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sniff(start: bytes) -> str:
    """bam, sam, sam.gz or cram. The name of the file plays no part."""
    if start[:2] == b"\x1f\x8b":
        return "bam" if zlib.decompressobj(31).decompress(start, 4) == b"BAM\1" else "sam.gz"
    return "cram" if start[:4] == b"CRAM" else "sam"


def inflated(file, chunk: int = 1 << 20):
    """Bytes of a file of gzip members, such as BGZF, in pieces."""
    left, inflater = b"", None
    while True:
        data = left or file.read(chunk)
        left = b""
        if not data:
            return
        inflater = inflater or zlib.decompressobj(31)
        out = inflater.decompress(data)
        if out:
            yield out
        if inflater.eof:
            left, inflater = inflater.unused_data, None
