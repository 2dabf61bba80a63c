"""FASTQ files as a Spark data source ``fastq``, in batches and as a stream.

Plain files are cut into byte ranges; a read belongs to the range that holds its first byte. A range that does not begin a
file looks for the first line from which on four-line frames fit: ``@`` line, sequence, ``+`` line, quality of the sequence's
length. A quality may begin with ``@``, so the marks alone say nothing; where several places fit, more frames decide, and
where all fit to the end of what is looked at, lines are counted from the file's start. A frame that does not fit is an error.
Blank lines after the last read are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .ranges import SPLIT, Bytes, Range, is_packed, listed, split

SCHEMA = "file string, block long, place long, name string, seq string, qual string"
#: frames that are looked at to find where a range's first read begins, and reads of a batch
LOOK, BATCH = 16, 4096
#: tasks that short ranges are dealt to, as long as a task has at most ``SPLIT`` bytes
TASKS = 512


def _fits(frame: list[bytes]) -> bool:
    """Whether four lines may be a read; three where an empty quality ends the file."""
    if len(frame) == 3 and not frame[1]:
        frame = [*frame, b""]
    return len(frame) == 4 and frame[0][:1] == b"@" and frame[1][:1] not in (b"@", b"+") and frame[2][:1] == b"+" and len(frame[1]) == len(frame[3])


def first_read(path: str, start: int) -> int | None:
    """Place of the first read that begins at ``start`` or later; None if there is none."""
    if start == 0:
        return 0
    # the first line that begins at start or later
    with Bytes(path, start - 1) as file:
        lines = file.lines()
        next(lines, None)
        near = list(islice(lines, 4 * LOOK + 3))
    while near and not near[-1][1]:  # blank lines at the end
        near.pop()
    if not near:
        return None
    whole = len(near) < 4 * LOOK
    able = []
    for k in range(min(4, len(near))):
        frames = [[x for _, x in near[i : i + 4]] for i in range(k, len(near), 4)]
        if not whole:
            frames = [f for f in frames if len(f) == 4]
        if frames and all(_fits(f) for f in frames):
            able.append(near[k][0])
    if len(able) == 1:
        return able[0]
    if not able and whole and len(near) < 4:
        return None  # the end of a read that began before the range
    if not able:
        raise ValueError(f"{path}: no read of four lines begins behind byte {start}")
    with Bytes(path) as file:  # several places fit: lines are counted
        return next((place for i, (place, _) in enumerate(file.lines()) if i % 4 == 0 and place >= start), None)


def frames(path: str, start: int | None, end: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(place, header, sequence, quality) of the reads that begin in [start, end); start is the first of them."""
    if start is None:
        return
    with Bytes(path, start) as file:
        lines = file.lines()
        for place, head in lines:
            if place >= end and not is_packed(path):
                return
            if not head:
                if any(line for _, line in lines):
                    raise ValueError(f"{path}: blank line among reads at byte {place}")
                return
            rest = [line for _, line in islice(lines, 3)]
            if len(rest) == 2 and not rest[0]:
                rest.append(b"")  # an empty read at the end of a file without a last line end
            if len(rest) < 3 or head[:1] != b"@" or rest[1][:1] != b"+" or len(rest[0]) != len(rest[2]):
                raise ValueError(f"{path}: no read of four lines at byte {place}")
            yield place, head[1:], rest[0], rest[2]


def whole_until(path: str, size: int, known: int) -> int:
    """Where the first read of a growing file begins that is not yet whole, from a place known to begin one; ``size`` if all are."""
    # the last reads decide; looked for from further ahead as long as none is found
    back = 1 << 16
    while True:
        start = max(known, size - back)
        place = known if start == known else first_read(path, start)
        if place is not None or start == known:
            break
        back *= 4
    place = known if place is None else place
    with Bytes(path, place) as file:
        lines = file.lines()
        for at, head in lines:
            rest = [line for _, line in islice(lines, 3)]
            if at >= size or head and (len(rest) < 3 or len(rest[0]) != len(rest[2])):
                return min(at, size)
    return size


class _Reads:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("say which path to load")
        self.most = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, found = partition.path, frames(partition.path, first_read(partition.path, partition.start), partition.end)
        while rows := list(islice(found, BATCH)):
            place, head, seq, qual = zip(*rows, strict=True)
            name = [h.split(None, 1)[0] if h.strip() else b"" for h in head]
            text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([partition.start] * len(rows), pa.int64()), pa.array(place, pa.int64()), text(name), text(seq), text(qual)], names=["file", "block", "place", "name", "seq", "qual"])


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: tuple[Range, ...]


class _BatchReads(_Reads, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        found = [r for path, size in listed(self.path) for r in split(path, 0, size, size, self.most)]
        enough = min(SPLIT, sum(r.end - r.start for r in found) // TASKS)
        out, some, held = [], [], 0
        for one in found:
            if some and held + one.end - one.start > enough:
                out.append(Ranges(tuple(some)))
                some, held = [], 0
            some.append(one)
            held += one.end - one.start
        return [*out, Ranges(tuple(some))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from super().read(one)


class _StreamedReads(_Reads, DataSourceStreamReader):
    """Offsets are bytes of each file that are done, always at a read's begin, so a batch that runs again has the same reads."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in listed(self.path):
            before = self.seen.get(path, (-1, 0))
            if before[0] != size:
                self.seen[path] = size, size if is_packed(path) else whole_until(path, size, before[1])
        return {path: done for path, (_, done) in sorted(self.seen.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, done in sorted(end.items()) if done > start.get(path, 0) for r in split(path, start.get(path, 0), done, done, self.most)]


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: a file or a folder of files, plain or gzipped; option splitBytes.

    Columns: file, block (the range's begin), place (the read's first byte), name, seq, qual. As a stream, files may appear
    and plain ones may grow; a read is taken once it is whole. Files are opened by pyarrow (local, HDFS, S3, GCS); for stores
    that only Spark reads there is ``fastx.read_fastq``.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReads(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamedReads(self.options)


def scan_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(read_ix, file_ix, name, seq, qual): reads of the files in order of their names, numbered over all and inside their file.

    A task yields the reads of a range in order, so their numbers come from the first one's and the reads are not shuffled; the
    first ones and their ranges' counts, one row a range, are broadcast.
    """
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("fastq").option("splitBytes", str(split_bytes)).load(path)
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("_c"), F.min("_id").alias("_first"))
    before = lambda window: (F.sum("_c").over(window) - F.col("_c")).cast("long")
    base = sizes.select("file", "block", "_first", before(Window.orderBy("file", "block")).alias("_base"), before(Window.partitionBy("file").orderBy("block")).alias("_own"))
    i = F.col("_id") - F.col("_first")
    return rows.join(F.broadcast(base), ["file", "block"]).select((F.col("_base") + i).alias("read_ix"), (F.col("_own") + i).alias("file_ix"), "name", "seq", "qual")


def stream_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """The reads of a folder as a stream (file, block, place, name, seq, qual); file and place say which read it is."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("fastq").option("splitBytes", str(split_bytes)).load(path)
