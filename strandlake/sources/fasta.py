"""FASTA files as a Spark data source ``fasta`` that cuts records into pieces, so that no record has to fit in a row.

Plain files are cut into byte ranges. A range owns its bytes, whatever lines they belong to; a header belongs to the range
that holds its ``>``. Each range counts its headers and bases as it goes, so that numbers and places of all pieces follow
from prefix sums over the ranges alone. Files are ASCII; any other byte of a sequence reads as one N.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .ranges import SPLIT, Bytes, Range, is_packed, line_start, listed, split

SCHEMA = "file string, block long, header string, records long, bases long, since long, seq string"
#: characters of a piece, and characters and rows of a batch
PIECE, BATCH_CHARS, BATCH_ROWS = 1 << 16, 1 << 22, 4096
_BLANK = b" \t\r\n\x0b\x0c"
_ASCII = bytes(b if b < 128 else 78 for b in range(256))


def pieces_of(path: str, start: int, end: int, most: int = PIECE) -> Iterator[tuple[str | None, bytes]]:
    """(header or None, characters of the sequence, at most ``most``) of the bytes [start, end). A header comes with its record's first characters, or with none."""
    packed = is_packed(path)
    own_line = packed or start == 0 or line_start(path, start) == start
    skips = False
    if not own_line:
        with Bytes(path, line_start(path, start)) as file:
            skips = next(file.steps(1), b"")[:1] == b">"
    header, head, held, size = None, None, [], 0  # the header to give next, the one that is being read, characters that wait
    place = start
    with Bytes(path, start) as file:
        for data in file.steps():
            at, over = 0, False
            while at < len(data):
                if skips or head is not None:
                    to = data.find(b"\n", at)
                    line = data[at : to if to >= 0 else len(data)]
                    at = to + 1 if to >= 0 else len(data)
                    if head is not None:
                        head.append(line)
                        if to >= 0:
                            header, head = b"".join(head)[1:].decode("utf-8", "replace").rstrip("\r"), None
                    if to >= 0:
                        skips, own_line = False, True
                    continue
                if not packed and place + at >= end:
                    over = True
                    break
                if own_line and data[at : at + 1] == b">":
                    if header is not None or held:
                        yield header, b"".join(held)
                    header, held, size, head, own_line = None, [], 0, [], False
                    continue
                to = data.find(b"\n>", at)
                to = to + 1 if to >= 0 else len(data)
                to = to if packed else min(to, end - place)
                own_line = data[to - 1 : to] == b"\n"
                part = data[at:to].translate(_ASCII, _BLANK)
                at = to
                if part:
                    held.append(part)
                    size += len(part)
                if size >= most:
                    whole = b"".join(held)
                    for i in range(0, size - size % most, most):
                        yield header, whole[i : i + most]
                        header = None
                    rest = whole[size - size % most :]
                    held, size = [rest] if rest else [], len(rest)
            place += len(data)
            if over or not packed and place >= end and head is None and not skips:
                break
    if head is not None:  # a header ends the file
        header = b"".join(head)[1:].decode("utf-8", "replace").rstrip("\r")
    if header is not None or held:
        yield header, b"".join(held)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("say which path to load")
        self.most, self.piece = int(options.get("splitbytes", options.get("splitBytes", SPLIT))), int(options.get("piece", PIECE))

    def partitions(self) -> list[Range]:
        return [r for path, size in listed(self.path) for r in split(path, 0, size, size, self.most)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, chars, records, bases, since = [], 0, 0, 0, None

        def batch() -> pa.RecordBatch:
            header, number, before, begun, seq = zip(*rows, strict=True)
            columns = [pa.array([partition.path] * len(rows)), pa.array([partition.start] * len(rows), pa.int64()), pa.array(header, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (number, before, begun)), pa.array(seq, pa.binary()).cast(pa.string())], names=["file", "block", "header", "records", "bases", "since", "seq"])

        for header, seq in pieces_of(partition.path, partition.start, partition.end, self.piece):
            if header is not None:
                records, since = records + 1, bases
            rows.append((header, records, bases, since, seq))
            bases, chars = bases + len(seq), chars + len(seq)
            if chars >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                yield batch()
                rows, chars = [], 0
        if rows:
            yield batch()


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``: a file or a folder of files, plain or gzipped; options splitBytes and piece.

    A row is a piece of a record: header (where the record begins), records and bases (headers of the range up to it,
    characters ahead of it), since (characters of the range ahead of the record's header, null if that lies in a range before).
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan_fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(records, pieces): (record_ix, name, description), and (record_ix, start, seq) with start counted in the record.

    Records are numbered in the order of the files' names; text ahead of a file's first header is no record. Only totals of
    the ranges meet in one place. The files are read for these, and again for what is asked of records and pieces.
    """
    spark.dataSource.register(FastaSource)
    rows = spark.read.format("fasta").option("splitBytes", str(split_bytes)).option("piece", str(piece)).load(path)
    blocks = rows.groupBy("file", "block").agg(F.max("records").alias("r"), F.sum(F.length("seq")).alias("b"), F.max("since").alias("s"))
    over, inside = Window.orderBy("file", "block"), Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("ahead", F.sum("b").over(over) - F.col("b"))
    begun = F.when(F.col("r") > 0, F.col("ahead") + F.col("s"))
    blocks = blocks.select("file", "block", "ahead", (F.sum("r").over(over) - F.col("r")).alias("earlier"), (F.sum("r").over(inside) - F.col("r")).alias("in_file"), F.last(begun, True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(blocks, ["file", "block"]).where("in_file + records > 0")
    rows = rows.withColumn("record_ix", F.expr("earlier + records - 1")).withColumn("start", F.expr("ahead + bases - coalesce(ahead + since, carried)"))
    name, rest = F.regexp_extract("header", r"^(\S*)", 1), F.trim(F.regexp_extract("header", r"^\S*\s+(.*)$", 1))
    records = rows.where("header is not null").select("record_ix", name.alias("name"), F.when(rest != "", rest).alias("description"))
    return records, rows.where("seq <> ''").select("record_ix", "start", "seq")
