"""Bases stored four to a byte: the bit codec, ranges cut out of the bytes, and k-mers read from them.

Base i of a chunk lies in byte i / 4 at bit 2 (i mod 4) (see ``kmer.byte_shift``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: coded bases of a chunk, and of the next one that follow in it, so that a short range or a k-mer lies in one chunk
SIZE, OVERLAP = 4096, 256
_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)


def encode(digits: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows that lie behind each other -> (bytes, offsets); each row begins a byte."""
    size = np.diff(offsets)
    out = np.concatenate(([0], np.cumsum(-(-size // 4))))
    spread = np.zeros(int(out[-1]) * 4, np.uint8)
    spread[np.arange(len(digits)) + np.repeat(out[:-1] * 4 - offsets[:-1], size)] = digits
    return np.bitwise_or.reduce(spread.reshape(-1, 4) << _SHIFTS, axis=1), out


def decode(data: np.ndarray) -> np.ndarray:
    """Codes of all bases in the bytes, those that fill up a row's last byte included."""
    return ((data[:, None] >> _SHIFTS) & 3).ravel()


def _buffers(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column without nulls."""
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray, kind, narrow):
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(narrow)


def pack(chunks: DataFrame) -> DataFrame:
    """(bin, record_ix, contig_ix, start, digits) -> with n and ``bases``, a BINARY, in place of digits."""
    names = ["bin", "record_ix", "contig_ix", "start"]

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("digits"), pa.large_string())
            packed, at = encode(data - 48, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(offsets).astype(np.int32)), _strings(packed, at, pa.large_binary(), pa.binary())], names=[*names, "n", "bases"])

    types = dict(chunks.dtypes)
    return chunks.select(*names, "digits").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", n int, bases binary")


def range_scan(ranges: DataFrame, stored: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """ranges (record_ix, contig_ix, lo, hi, ...) with the code digits of the coded bases lo+1 .. hi; lo >= hi gives none.

    A range is joined with the chunk where it begins, or if longer than ``overlap`` with each chunk that it covers; of a
    chunk, only the bytes that it touches go on, and in these it is cut by its bit place. Repeated ranges each give a row.
    """
    names = ranges.columns
    rows = ranges.where("lo < hi")
    chunks = stored.select("bin", "record_ix", "contig_ix", F.col("start").alias("_start"), F.col("bases").alias("_bases"))
    short = (F.col("hi") - F.col("lo") <= overlap).alias("_short")
    bins = F.when(short, F.array(F.floor(F.col("lo") / size))).otherwise(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size)))
    rows = rows.select("*", short, F.explode(bins).alias("bin")).join(chunks, ["record_ix", "contig_ix", "bin"])
    first = F.greatest(F.col("lo"), F.col("_start")) - F.col("_start")
    last = F.when(F.col("_short"), F.col("hi")).otherwise(F.least(F.col("hi"), (F.col("bin") + 1) * size)) - F.col("_start")
    byte = F.floor(first / 4)
    cut = F.substring("_bases", (byte + 1).cast("int"), (F.ceil(last / 4) - byte).cast("int"))
    rows = rows.select(*names, "bin", (first - byte * 4).cast("int").alias("_skip"), (last - first).cast("int").alias("_n"), cut.alias("_cut"))
    types = dict(rows.dtypes)
    kept = [*names, "bin"]

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("_cut"), pa.large_binary())
            codes = decode(data)
            skip, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("_skip", "_n"))
            at = np.concatenate(([0], np.cumsum(n)))
            digits = codes[np.arange(at[-1]) + np.repeat(offsets[:-1] * 4 + skip - at[:-1], n)] + 48
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _strings(digits, at, pa.large_string(), pa.string())], names=[*kept, "_part"])

    rows = rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", _part string")
    one = rows.where(F.col("hi") - F.col("lo") <= overlap).select(*names, F.col("_part").alias("bases"))
    more = rows.where(F.col("hi") - F.col("lo") > overlap).groupBy(*names).agg(F.array_sort(F.collect_set(F.struct("bin", "_part"))).alias("p"), F.count("*").alias("n"))
    again = F.explode(F.expr("array_repeat(array_join(p._part, ''), int(n / size(p)))"))  # equal ranges met in one group
    return one.unionByName(more.select(*names, again.alias("bases")))


def short_scan(ranges: DataFrame, stored: DataFrame, most: int, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``range_scan`` of ranges of at most ``most`` bases, no more than ``overlap``, which meet their chunks and are cut once. All ranges stay; one that does not lie in its contig, or is empty, has null bases.

    A range longer than ``most`` ends the job with an error.
    """
    if most > overlap:
        raise ValueError("short ranges must fit in the overlap of the chunks")
    chunks = stored.select("bin", "record_ix", "contig_ix", F.col("start").alias("_start"), (F.col("start") + F.col("n")).alias("_end"), F.col("bases").alias("_bases"))
    return _cut(ranges.withColumn("bin", F.floor(F.col("lo") / size)).join(chunks, ["record_ix", "contig_ix", "bin"], "left"), ranges, F.col("lo"), F.col("hi"), most)


def scan_at(ranges: DataFrame, lo: Column, hi: Column, stored: DataFrame, most: int, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``short_scan`` of the coded bases lo+1 .. hi, which ``ranges`` give by columns of theirs. The place among all coded bases finds the chunk without its contig, and what lo and hi are made of is dealt out once, without them."""
    if most > overlap:
        raise ValueError("short ranges must fit in the overlap of the chunks")
    chunks = stored.select(F.col("bin").alias("_bin"), F.col("start").alias("_start"), (F.col("start") + F.col("n")).alias("_end"), F.col("bases").alias("_bases"))
    met = (F.floor(lo / size) == F.col("_bin")) & (lo >= F.col("_start")) & (hi <= F.col("_end")) & (lo < hi)
    return _cut(ranges.join(chunks, met, "left"), ranges, lo, hi, most)


def _cut(rows: DataFrame, ranges: DataFrame, lo: Column, hi: Column, most: int) -> DataFrame:
    """ranges that have met their chunk (_start, _end, _bases) -> ranges with ``bases``, cut once."""
    names = ranges.columns
    first, n = lo - F.col("_start"), hi - lo
    said = F.raise_error(F.lit(f"a range is longer than {most} bases")).cast("boolean")
    inside = F.coalesce(F.when(n > most, said).otherwise((n > 0) & (first >= 0) & (hi <= F.col("_end"))), F.lit(False))
    byte = F.floor(first / 4)
    cut = F.when(inside, F.substring("_bases", (byte + 1).cast("int"), (F.ceil((first + n) / 4) - byte).cast("int")))
    rows = rows.select(*names, F.coalesce(cut, F.lit(b"")).alias("_cut"), F.when(cut.isNotNull(), first - byte * 4).otherwise(0).cast("int").alias("_skip"), F.when(cut.isNotNull(), n).otherwise(0).cast("int").alias("_n"))

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("_cut"), pa.large_binary())
            skip, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("_skip", "_n"))
            at = np.concatenate(([0], np.cumsum(n)))
            digits = decode(data)[np.arange(at[-1]) + np.repeat(offsets[:-1] * 4 + skip - at[:-1], n)] + 48
            bases = pc.if_else(pa.array(n > 0), _strings(digits, at, pa.large_string(), pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), bases], names=[*names, "bases"])

    return rows.mapInArrow(run, StructType([*ranges.schema.fields, StructField("bases", StringType())]))


#: k-mers that are read and sorted together, and those that go out at once
SORTED, OUT = 1 << 22, 1 << 17


def _read_kmers(k: int, size: int):
    """Rows go out by k-mer in runs of some SORTED (a chunk is not parted): equal ones lie together, and their files are smaller."""

    def read(batch: pa.RecordBatch, many: np.ndarray) -> pa.RecordBatch:
        data, offsets = _buffers(batch.column("bases"), pa.large_binary())
        codes = decode(data)
        start = batch.column("start").to_numpy()
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(offsets[:-1] * 4, many) + inside
        dna, rc = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for j in range(k):
            base = codes[first + j].astype(np.int64)
            dna |= base << 2 * j
            rc |= (base ^ 2) << 2 * (k - 1 - j)
        pos, order = np.repeat(start, many) + inside + k, np.argsort(dna, kind="stable")
        row = pa.array(np.repeat(np.arange(len(many)), many)[order])
        return pa.RecordBatch.from_arrays([batch.column("record_ix").take(row), batch.column("contig_ix").take(row), pa.array(pos[order]), pa.array(dna[order]), pa.array(rc[order])], names=["record_ix", "contig_ix", "pos", "dna", "rc"])

    def run(batches):
        held, sizes = [], []
        for batch in batches:
            n, start, cell = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "start", "bin"))
            many = np.maximum(0, np.minimum(n - k + 1, (cell + 1) * size - start))  # k-mers that begin at an own base
            through, lo = np.cumsum(many), 0
            while lo < len(many):
                room = SORTED - sum(int(x.sum()) for x in sizes)
                hi = max(lo + 1, int(np.searchsorted(through, through[lo] - many[lo] + room, "right")))
                held.append(batch.slice(lo, hi - lo))
                sizes.append(many[lo:hi])
                if hi < len(many):
                    yield from out(held, sizes)
                    held, sizes = [], []
                lo = hi
        if held:
            yield from out(held, sizes)

    def out(held, sizes):
        rows = read(pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.concatenate(sizes))
        for lo in range(0, len(rows), OUT):
            yield rows.slice(lo, OUT)

    return run


def kmers(stored: DataFrame, k: int, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(record_ix, contig_ix, pos, dna, rc): k-mers of both strands that end at each base, read from the bytes of stored chunks; in no order of places."""
    if k - 1 > overlap:
        raise ValueError("a k-mer must fit in the overlap of the chunks")
    contig = dict(stored.dtypes)["contig_ix"]
    return stored.select("bin", "record_ix", "contig_ix", "start", "n", "bases").mapInArrow(_read_kmers(k, size), f"record_ix long, contig_ix {contig}, pos long, dna long, rc long")
