"""Files cut into byte ranges, for data sources: listing, opening, and lines with their places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: bytes of a range where nothing else is said, and bytes that are read at once
SPLIT, STEP = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file of ``size`` bytes. A compressed file is one range, its places are those of the plain bytes."""

    path: str
    start: int
    end: int
    size: int


def _found(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def is_packed(path: str) -> bool:
    return path.endswith((".gz", ".bgz"))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in order of their names; hidden ones are left out."""
    where, at = _found(path)
    one = where.get_file_info(at)
    if one.type == fs.FileType.File:
        return [(path, one.size)]
    if one.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    head = path.rstrip("/")
    files = where.get_file_info(fs.FileSelector(at))
    return sorted((f"{head}/{f.base_name}", f.size) for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._")


def split(path: str, start: int, end: int, size: int, most: int) -> list[Range]:
    if is_packed(path):
        return [Range(path, 0, end, size)]
    return [Range(path, lo, min(lo + most, end), size) for lo in range(start, end, most)]


class Bytes:
    """A file's bytes from a place on, in steps; compressed files are read from their start."""

    def __init__(self, path: str, start: int = 0):
        where, at = _found(path)
        self.place = start
        if is_packed(path):
            if start:
                raise ValueError("a compressed file has no ranges")
            self.file = where.open_input_stream(at, compression="gzip")
        else:
            self.file = where.open_input_file(at)
            self.file.seek(start)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def steps(self, step: int = STEP) -> Iterator[bytes]:
        while data := self.file.read(step):
            yield data

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """(place, line) without line ends, LF or CRLF; the last line may lack one. Rest after the last line end is a line only if it is not empty."""
        held, place = [], self.place
        for data in self.steps():
            *whole, rest = data.split(b"\n")
            for line in whole:
                held.append(line)
                line = b"".join(held) if len(held) > 1 else held[0]
                yield place, line[:-1] if line.endswith(b"\r") else line
                place, held = place + len(line) + 1, []
            if rest:
                held.append(rest)
        if held:
            line = b"".join(held)
            yield place, line[:-1] if line.endswith(b"\r") else line


def line_start(path: str, place: int) -> int:
    """Where the line that holds byte ``place`` begins; read backwards in steps."""
    where, at = _found(path)
    with where.open_input_file(at) as file:
        while place > 0:
            lo = max(0, place - STEP)
            file.seek(lo)
            end = file.read(place - lo).rfind(b"\n")
            if end >= 0:
                return lo + end + 1
            place = lo
    return 0
