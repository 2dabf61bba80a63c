"""Marks dealt out in bundles: many marks of one part make a row, whose columns are bytes, so that a mark takes some half of the bytes of a row of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import _buffers

#: marks that a task bundles at once, marks that come out of bundles at once, and parts that share a partition
HELD, OPENED, SHARED = 1 << 20, 1 << 17, 8


def by_kmer(kmers: np.ndarray, n: int) -> np.ndarray:
    """Which of n parts each k-mer goes to."""
    return ((kmers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bytes(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers, none negative, cut into rows -> binaries; each number takes as few bytes as the largest needs."""
    width = max(1, -(-int(numbers.max()).bit_length() // 8))
    data = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])


def _numbers(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """Numbers of the rows of a column made by ``_bytes``, n of each."""
    data, offsets = _buffers(column, pa.large_binary())
    width, at = np.diff(offsets) // n, np.concatenate(([0], np.cumsum(n)))
    out = np.zeros((at[-1], 8), np.uint8)
    cuts = np.flatnonzero(np.diff(width)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
        out[at[lo] : at[hi], : width[lo]] = data[offsets[lo] : offsets[hi]].reshape(-1, width[lo])
    return out.view("<i8").ravel()


def _bundles(part_of, n: int, more: tuple[str, ...]):
    """Marks -> for each part of every HELD of them a row; its places go up, and are given as the first one and the steps between them."""

    def bundle(rows: list[np.ndarray]) -> pa.RecordBatch:
        kmers, pos, ori, *others = rows
        part, place = part_of(kmers, n), pos << 1 | ori
        order = np.lexsort((place, part))
        part, place = part[order], place[order]
        heads = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
        cuts = np.append(heads, len(part))
        steps = np.diff(place, prepend=place[0])
        steps[heads] = 0
        least = [x.min() for x in others]
        arrays = [part[heads].astype(np.int32), np.diff(cuts), place[heads], *(np.full(len(heads), x) for x in least)]
        arrays = [*map(pa.array, arrays), *(_bytes(x, cuts) for x in (kmers[order], steps, *(x[order] - a for x, a in zip(others, least, strict=True))))]
        return pa.RecordBatch.from_arrays(arrays, names=_names(more))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kmer", "pos", "ori", *more)])
            size += len(batch)
            if size >= HELD:
                yield bundle([np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
        if size:
            yield bundle([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _names(more: tuple[str, ...]) -> list[str]:
    return ["part", "n", "first", *(f"{c}_least" for c in more), "kmers", "steps", *(f"{c}_beyond" for c in more)]


def _opened(more: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            lo, n = 0, batch.column("n").to_numpy()
            through = np.cumsum(n)
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(through, through[lo] - n[lo] + OPENED, "right")))
                rows, many = batch.slice(lo, hi - lo), n[lo:hi]
                steps, heads = _numbers(rows.column("steps"), many), np.cumsum(many) - many
                through_steps = np.cumsum(steps)
                place = through_steps + np.repeat(rows.column("first").to_numpy() - through_steps[heads], many)
                others = [_numbers(rows.column(f"{c}_beyond"), many) + np.repeat(rows.column(f"{c}_least").to_numpy(), many) for c in more]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (_numbers(rows.column("kmers"), many), place, *others))], names=["kmer", "place", *more])
                lo = hi

    return run


def dealt(marks: DataFrame, *more: str, part_of=by_kmer, keep: bool = False) -> DataFrame:
    """(kmer, place, ...): marks (kmer, pos, ori, and more columns of longs) dealt to partitions by k-mer; a place is twice the position and the strand.

    part_of: says which of n parts a k-mer goes to. keep: each part is a partition, however small; else several share one, and Spark may join small ones.
    """
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longs = lambda names: "".join(f", {c} long" for c in names)
    kinds = "part int, n long, first long" + longs(f"{c}_least" for c in more) + ", kmers binary, steps binary" + "".join(f", {c}_beyond binary" for c in more)
    rows = marks.select("kmer", "pos", "ori", *more).mapInArrow(_bundles(part_of, n if keep else n * SHARED, more), kinds)
    rows = rows.repartitionById(n, "part") if keep else rows.repartition("part")
    return rows.mapInArrow(_opened(more), "kmer long, place long" + longs(more))
