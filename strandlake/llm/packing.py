"""Pattern packing by non-negative least squares.

The histogram of piece lengths (at most ``capacity`` numbers) is all that reaches the driver. Patterns of one to three
lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares,
rounded down, and what is left is packed by best fit on the histogram. The plan gives ranges of ranks within each
length; every piece finds its sequence and offset from its length and its rank, so no piece list is ever gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy


#: the splitting pattern of byte-level BPE (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(tokenizer):
    """The tokenizer's own BPE by ranks, faster for text seen once; None unless its merges stand in the order of their ids."""
    import json

    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    if not plain or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # byte-level vocabularies write bytes as printable characters: those that print stand for themselves, the others follow from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    own = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: own.encode_to_numpy(text, disallowed_special=())


class TextEncoder:
    """Ids of many texts as the tokenizer file gives them (no special tokens added). Texts that hold a special token's string go through the tokenizer itself."""

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _ranked(self.tokenizer)
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or "(?!)")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.fast is None or self.special.search(t)]
        known = dict(zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True))
        return [np.array(known[i].ids, np.uint32) if i in known else self._ranked(t) for i, t in enumerate(texts)]

    def _ranked(self, text: str) -> np.ndarray:
        try:
            return self.fast(text)
        except ValueError:  # its pattern gives up on very long white space; the tokenizer's own does not
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """(doc_id, text) -> a row for each piece of its ids and end_id; a longer document's first piece takes what is over."""

    def run(batches):
        coder = TextEncoder(path)  # for this task only: some 40 MB that the worker would keep for all later steps
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids_of = coder.encode([t or "" for t in part.column("text").to_pylist()])
                owner, piece, start, length, crc, lists = [], [], [], [], [], []
                for i, ids in enumerate(ids_of):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        owner.append(i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            lists.append(ids[a:b].astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def _fit(patterns: np.ndarray, have: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of patterns (rows of three length classes, 0: none) with least squared error to ``have``, by accelerated projected gradient."""
    weight = (np.arange(len(have)) > 0).astype(float)
    step = 1.0 / (3.0 * np.bincount(patterns.ravel(), minlength=len(have))[1:].max())

    def used(x):
        return sum(np.bincount(patterns[:, j], x, len(have)) for j in range(patterns.shape[1]))

    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        wrong = (used(y) - have) * weight
        new = np.maximum(0, y - step * sum(wrong[patterns[:, j]] for j in range(patterns.shape[1])))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


#: (grain as a multiple, share of the fitted repeat counts) that are tried, until the sequences are as few as their lengths allow
TRIES = ((1.0, 1.0), (0.5, 0.6), (1.0, 0.3), (2.0, 0.3))


def plan(histogram: np.ndarray, capacity: int, grain: int = 32) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences that together hold just the pieces of the histogram (index: length).

    Patterns leave the residuals that best fit packs. With all of the fitted repeats the residuals may pack badly, so
    other grains and smaller shares are tried as well, and the plan with the fewest sequences is given.
    """
    least, best = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity), None
    for times, share in TRIES:
        found = _plan(histogram, capacity, max(1, int(grain * times)), share)
        n = sum(repeats for repeats, _ in found)
        if best is None or n < best[0]:
            best = n, found
        if n <= least:
            break
    return best[1]


def _plan(histogram: np.ndarray, capacity: int, grain: int, share: float) -> list[tuple[int, tuple[int, ...]]]:
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...], most: int | None = None) -> int:
        distinct, each = np.unique(lengths, return_counts=True)
        n = int((left[distinct] // each).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[distinct] -= n * each
            out.append((n, lengths))
        return n

    take((capacity,))
    # patterns of classes of lengths: class c holds ((c-1) * grain, c * grain]; class sums that can fill a sequence
    classes = -(-capacity // grain)
    a, b = np.meshgrid(np.arange(classes + 1), np.arange(classes + 1), indexing="ij")
    c = np.stack([a, b, classes + 1 - a - b], -1).reshape(-1, 3)
    c = c[(c >= 0).all(1) & (np.diff(c, axis=1) >= 0).all(1)]
    pairs = np.stack([np.zeros(classes, np.int64), *np.sort(np.stack([np.arange(1, classes + 1), classes + 1 - np.arange(1, classes + 1)]), 0)], 1)
    c = np.unique(np.concatenate([c, pairs, np.stack([a.ravel(), b.ravel(), classes - a.ravel() - b.ravel()], -1)[(a + b <= classes).ravel()]]), axis=0)
    c = np.unique(np.sort(c, 1), axis=0)
    c = c[(c.max(1) <= classes) & (c.min(1) >= 0) & (c.sum(1) > 0)]
    which = -(-np.arange(capacity + 1) // grain)
    repeats = np.floor(share * _fit(c, np.bincount(which, left, classes + 1))).astype(np.int64)

    def best(limit: int, low: int = 1) -> int:
        """Longest length that is left and at most ``limit``; 0: none."""
        at = np.flatnonzero(left[low : limit + 1])
        return int(at[-1]) + low if len(at) else 0

    for i in np.argsort(-repeats, kind="stable").tolist():
        pattern, want = [int(k) for k in c[i] if k][::-1], int(repeats[i])
        while want > 0:  # exact lengths of the pattern's classes: the first ones any, the last the best that fits
            lengths: list[int] = []
            for j, k in enumerate(pattern):
                room = capacity - sum(lengths)
                length = best(min(room, k * grain), (k - 1) * grain + 1)
                if not length:
                    break
                left[length] -= 1
                lengths.append(length)
            for length in lengths:
                left[length] += 1
            # only patterns that come out full are taken here; the rest is left for best fit
            if len(lengths) < len(pattern) or sum(lengths) < capacity:
                short = capacity - sum(lengths[:-1]) if len(lengths) == len(pattern) else 0
                if not (short and 0 < short <= capacity and left[short] > lengths[:-1].count(short)):
                    break
                lengths[-1] = short
            got = take(tuple(lengths), want)
            if not got:
                break
            want -= got
    # residuals: the longest piece first, then an exact partner, an exact pair, else the best fit
    while True:
        first = best(capacity)
        if not first:
            return out
        lengths = [first]
        left[first] -= 1
        room = capacity - first
        while room > 0 and (length := best(room)):
            if length < room:
                lows = np.flatnonzero(left[1 : room // 2 + 1]) + 1
                lows = lows[left[room - lows] > (lows * 2 == room)]
                if len(lows):
                    length = int(room - lows[0])
            lengths.append(length)
            left[length] -= 1
            room -= length
        for length in lengths:
            left[length] += 1
        take(tuple(lengths))


def _placed(segments: np.ndarray):
    """Sequence and offset from length and rank. segments: rows (length, first rank, first sequence, offset), sorted."""
    key = segments[:, 0] * (1 << 44) + segments[:, 1]

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy()
        at = np.searchsorted(key, length.to_numpy() * (1 << 44) + rank, "right") - 1
        return pd.DataFrame({"sequence_id": segments[at, 2] + rank - segments[at, 1], "offset": segments[at, 3]})

    return F.pandas_udf(find, "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, rows_per_group: int = 200_000) -> DataFrame:
    """Pack documents, each ended by ``end_id``, into sequences of at most ``capacity`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, ids (with ``with_ids``), sequence_id, offset. A null or
    empty text is the end id alone. Only documents longer than a sequence are cut. Repeated rows and equal or null
    doc_ids are documents of their own. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_pieces(tokenizer, capacity, end_id, with_ids)), columns), "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        histogram[length] = n
    segments, next_rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for repeats, lengths in plan(histogram, capacity) if len(counts) else ():
        offset = 0
        for length in lengths:
            segments.append((length, next_rank[length], sequence, offset))
            next_rank[length] += repeats
            offset += length
        sequence += repeats
    table = np.array(sorted(segments) or [(0, 0, 0, 0)], np.int64)
    # ranks within a length: a common length is numbered in groups, whose counts give the offsets
    groups = max(1, int(histogram.max()) // rows_per_group)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "group"]).withColumn("p", _placed(table)("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "p.sequence_id", "p.offset")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The contract query: all documents into sequences of 2048 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
