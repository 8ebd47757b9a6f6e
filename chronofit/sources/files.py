"""Byte ranges of files on any file system that a task can open."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it; file:/x, file:///x and /x are the same."""
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def listed(paths: list[str], suffix: str = r".*") -> list[tuple[str, int]]:
    """(path, size) of files, and of those directly in folders whose names match the suffix; the greatest first, then by path."""
    out = []
    for path in paths:
        fs, at = opened(path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            inside = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File and re.search(suffix, x.path, re.IGNORECASE)]
            prefix = path.rstrip("/")
            out += [(f"{prefix}/{x.base_name}", x.size) for x in inside]
        elif info.type == pafs.FileType.File:
            out.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return sorted(out, key=lambda x: (-x[1], x[0]))


class Window:
    """Bytes of an open file by place, read in blocks; places are to rise, but for short steps back."""

    def __init__(self, f, size: int, block: int = 8 << 20):
        self.f, self.size, self.block = f, size, block
        self.at, self.data = 0, b""

    def take(self, at: int, n: int) -> memoryview:
        """n bytes from a place on, fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(min(max(n, self.block), max(0, self.size - at)))
        return memoryview(self.data)[at - self.at : at - self.at + n]
