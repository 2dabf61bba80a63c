"""Shared pieces: durable intermediate tables, and batched word hashing on Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints"
MIN_LONG = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a local folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or LOCAL_SHARED


def materialize(df: DataFrame, name: str, drops: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    drops: tables written before that nothing reads after this one; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop(*drops)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._stored_at
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def _trim() -> None:
    """Give freed memory back to the system, where the C library knows how to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A step over batches that leaves no freed memory in its worker, which goes on to other steps."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def text_key(text: Column) -> Column:
    """64-bit identity of a whole text (null where the text is null)."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def doc_order(doc_id: str = "doc_id") -> Column:
    """Document order with a null id first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(MIN_LONG))


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with names used inside."""
    return df.select(*cols)


# --- words ----------------------------------------------------------------------------------------
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: longest word in bytes that is hashed in arrays, eight bytes at a time
LONG_WORD = 64
_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser, a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word data[start:end]. Of one size up to eight bytes, different words never meet.

    Words up to LONG_WORD bytes are mixed eight bytes after eight, longer ones are hashed by BLAKE2b. Two seeds give 128 bits.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(int(_MULT) * (seed + 1) & (1 << 64) - 1))
    live = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else slice(None)
    at, left = start[live], size[live]
    while len(at):
        h[live] = mix(h[live] ^ (eight[at] & _KEPT[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")
    return h


def _class(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], bool)


#: bytes of words, of letters with what is not ASCII, and of letters and digits with what is not ASCII
WORD_BYTES = _class(lambda b: b != 32 and not 9 <= b <= 13)
LETTER_BYTES = _class(lambda b: b >= 128 or chr(b).isalpha())
TERM_BYTES = _class(lambda b: b >= 128 or chr(b).isalnum())


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, or runs of other bytes, of several texts that lie behind each other in one byte buffer.

    hash: 64-bit hash per word; start, end: byte places; first: index of each text's first word (one more entry at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, of: np.ndarray = WORD_BYTES):
        n = len(data)
        inside = of[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        apart = edge[1:n] | ~inside[: n - 1] if n else np.zeros(0, bool)
        begins = inside.copy()
        begins[1:] &= apart
        ends = inside.copy()
        ends[: n - 1] &= edge[1:n] | ~inside[1:] if n else True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = word_hashes(data, self.start, self.end, lower)

    def grams(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one text. hashes: others of the words than ``hash``."""
        hashes = self.hash if hashes is None else hashes
        n = len(hashes)
        out = np.zeros(n, np.uint64)
        m = n - size + 1
        if m > 0:
            total = np.zeros(m, np.uint64)
            for j in range(size):
                total *= _MULT
                total += hashes[j : j + m]
            out[:m] = mix(total)
        text = self.text_of_word()
        good = np.arange(n) + size <= self.first[1:][text] if n else np.zeros(0, bool)
        return out, good

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = 1 << 19):
    """(lo, hi, bytes, offsets) of runs of texts with about ``most`` bytes; a longer text stands alone. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def sliding_min(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value, and its leftmost place, of each ``width`` successive values."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, place, have = value, np.arange(len(value)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        left = best[:m] <= best[step : step + m]
        best, place = np.where(left, best[:m], best[step : step + m]), np.where(left, place[:m], place[step : step + m])
        have += step
    return best, place
