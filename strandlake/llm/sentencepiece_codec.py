"""SentencePiece encoding and decoding with batched numpy.

A text is cut into units, white space with the word behind it, which pieces never cross. New units of equal length
advance together: substrings are hashed from prefix hashes, the hashes probe the sorted piece keys, and vectorised
maxima store backpointers (``viterbi``): the pieces with the greatest sum of scores. That is how a unigram model encodes.
A BPE model has scores too, and its best sum is given for it as well; but its own ids come from merges, so beside them
the same probing and maxima choose the merges (``merge``), which gives the ids of the library.
Characters outside the vocabulary fall back to byte pieces. Both read one table of known substrings. A unit over ``LONG``
characters goes alone, through its known substrings and a heap of pairs, in time that grows as its length.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: units kept in the cache of a process, and units that advance together
CACHE, BATCH = 200_000, 4096
#: a unit of more characters is encoded alone; first bits by which keys are found
LONG, HEAD = 512, 17
#: if these normalise to themselves but for spaces, the model has no rules of its own
PROBES = ("", " ", "a  b ", "\t\r\n x", "ﬁ ＡＢ Å Å é e\u0301", "\u00a0\u3000\u200b\u00ad½ ① ㌀", "A\x00\x07", "ß ſ İ ΐ 한 한")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _MULT, np.uint64))), dtype=np.uint64)


class Pieces:
    """Vocabulary: sorted hashes of pieces with their ids and scores, ids of the byte pieces, and what each id decodes to."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: 'normal', 'byte', 'control' or 'unknown' of each id."""
        normal = [i for i, k in enumerate(kinds) if k == "normal" and pieces[i]]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.powers = _powers(max(self.longest, 1) + 1)
        hashes = np.array([self.of(pieces[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.keys, self.ids = hashes[order], np.array(normal, np.int64)[order]
        self.scores = np.array([scores[i] for i in normal])[order]
        # where the keys of each head of bits begin, and the longest run of keys of one head
        heads = (self.keys >> np.uint64(64 - HEAD)).astype(np.int64)
        self.head = np.searchsorted(heads, np.arange((1 << HEAD) + 1)).astype(np.int32)
        self.run = int(np.diff(self.head).max(initial=0))
        self.bytes = np.full(256, kinds.index("unknown") if "unknown" in kinds else 0, np.int64)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.text = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_bpe = len(normal) > 1 and bool((np.diff(sorted(scores[i] for i in normal)) > 0).mean() > 0.9 and all(float(scores[i]).is_integer() for i in normal))

    def of(self, s: str) -> np.uint64:
        return mix(prefix_hashes(np.array([[ord(c) for c in s]]))[:, -1])[0]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "normal" for i in range(n)]
        out = cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)
        if any(sp.normalize(t) != out.normalize(t) for t in PROBES):
            out.normalize = sp.normalize
        return out

    def normalize(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted keys, or -1: the few keys that share its first bits are compared."""
        head = (hashes >> np.uint64(64 - HEAD)).astype(np.int64)
        at, end = self.head[head], self.head[head + 1]
        out = np.full(hashes.shape, -1, np.int32)
        for _ in range(self.run):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            hit = live[self.keys[at[live]] == hashes[live]]
            out[hit] = at[hit]
            at[hit] = end[hit]
            at += 1
        return out

    def table(self, codes: np.ndarray) -> np.ndarray:
        """[row, end - 1, longest - length]: place of each substring of up to ``longest`` characters among the keys, or -1. Both encodings read it."""
        rows, length = codes.shape
        prefix, out = prefix_hashes(codes), np.full((rows, length, self.longest), -1, np.int32)
        for n in range(1, min(self.longest, length) + 1):
            hashes = mix(prefix[:, n:] - prefix[:, :-n] * self.powers[n])
            out[:, n - 1 :, self.longest - n] = self.probe(hashes.ravel()).reshape(rows, -1)
        return out


def _spans(table: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    longest = table.shape[2]
    length = end - start
    return np.where((length > 0) & (length <= longest), table[row, np.maximum(end - 1, 0), np.maximum(longest - length, 0) % longest], -1)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of the rows of ``codes`` (words x length)."""
    rows, length = codes.shape
    out = np.zeros((rows, length + 1), np.uint64)
    if rows >= length:
        for i in range(length):
            out[:, i + 1] = out[:, i] * _MULT + codes[:, i].astype(np.uint64) + np.uint64(1)
    else:  # few long rows: sums of characters by powers of the inverse, brought back by powers
        inverse = np.cumprod(np.full(length, pow(int(_MULT), -1, 1 << 64), np.uint64), dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * inverse, axis=1, dtype=np.uint64, out=out[:, 1:])
        out[:, 1:] *= _powers(length)[1:]
    return out


def viterbi(codes: np.ndarray, pieces: Pieces, unknown: float = -100.0, table: np.ndarray | None = None) -> np.ndarray:
    """Ends of the best pieces of each row, as a mask over positions 1..length: greatest sum of scores, all rows at once.

    ``unknown`` is the score of a single character outside the vocabulary. Of equal sums the longest last piece wins.
    """
    rows, length = codes.shape
    table = pieces.table(codes) if table is None else table
    every, longest = np.arange(rows), pieces.longest
    score = np.where(table >= 0, pieces.scores[table], -np.inf)
    score[:, :, -1] = np.where(table[:, :, -1] >= 0, score[:, :, -1], unknown)
    # sums up to each end, behind as many places that nothing reaches
    best = np.full((rows, longest + length + 1), -np.inf)
    best[:, longest] = 0
    back = np.zeros((rows, length + 1), np.int64)
    for end in range(1, length + 1):
        sums = score[:, end - 1] + best[:, end : end + longest]
        pick = sums.argmax(1)
        best[:, longest + end], back[:, end] = sums[every, pick], end - longest + pick
    mask, at = np.zeros((rows, length), bool), np.full(rows, length)
    while (at > 0).any():
        mask[every[at > 0], at[at > 0] - 1] = True
        at = back[every, at]
    return mask


def viterbi_long(table: np.ndarray, pieces: Pieces, unknown: float = -100.0) -> np.ndarray:
    """``viterbi`` of one long row, from its known spans alone."""
    length, longest = table.shape[1:]
    end, place = np.nonzero(table[0] >= 0)
    spans = zip((end + 1).tolist(), (end + 1 - longest + place).tolist(), pieces.scores[table[0][end, place]].tolist(), strict=True)
    best, back = [0.0, *[-math.inf] * length], [0] * (length + 1)
    known = (table[0, :, -1] >= 0).tolist()
    span = next(spans, None)
    for e in range(1, length + 1):
        top, where = -math.inf, 0
        while span is not None and span[0] == e:  # the longest first
            value = best[span[1]] + span[2]
            if value > top:
                top, where = value, span[1]
            span = next(spans, None)
        if not known[e - 1] and best[e - 1] + unknown > top:
            top, where = best[e - 1] + unknown, e - 1
        best[e], back[e] = top, where
    mask, at = np.zeros((1, length), bool), length
    while at > 0:
        mask[0, at - 1] = True
        at = back[at]
    return mask


def merge_long(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """``merge`` of one long row, by a heap of pairs: the best-scored leftmost one first; a pair that has changed since is left."""
    length, longest = table.shape[1:]
    end, ahead, alive = list(range(1, length + 1)), list(range(-1, length)), [True] * length
    at = np.flatnonzero(table[0, 1:, longest - 2] >= 0) if longest > 1 else np.zeros(0, np.int64)
    heap = list(zip((-pieces.scores[table[0, at + 1, longest - 2]]).tolist(), at.tolist(), (at + 2).tolist(), strict=True)) if len(at) else []
    heapq.heapify(heap)
    scores, found = pieces.scores, table[0]

    def offer(left: int, to: int) -> None:
        if to - left <= longest:
            place = found[to - 1, longest - (to - left)]
            if place >= 0:
                heapq.heappush(heap, (-float(scores[place]), left, to))

    while heap:
        _, left, to = heapq.heappop(heap)
        right = end[left]
        if not alive[left] or right >= length or end[right] != to:
            continue
        end[left], alive[right] = to, False
        if to < length:
            ahead[to] = left
            offer(left, end[to])
        if ahead[left] >= 0:
            offer(ahead[left], to)
    mask = np.zeros((1, length), bool)
    mask[0, [e - 1 for e, a in zip(end, alive, strict=True) if a]] = True
    return mask


def merge(codes: np.ndarray, pieces: Pieces, table: np.ndarray | None = None) -> np.ndarray:
    """Ends of the pieces of each row, as a mask: in every step each row merges its best-scored leftmost pair of neighbours."""
    rows, length = codes.shape
    table = pieces.table(codes) if table is None else table
    # edges[i, j]: start of the j-th symbol; behind the last symbol: length
    edges = np.tile(np.arange(length + 1), (rows, 1))
    active = np.arange(rows)
    final = edges.copy()
    rank = None
    while len(active):
        width = edges.shape[1] - 2
        if width < 1:
            break
        if rank is None:
            found = _spans(table, np.repeat(active, width), edges[:, :-2].ravel(), edges[:, 2:].ravel())
            rank = np.where(found >= 0, pieces.scores[found], -np.inf).reshape(-1, width)
        pick = rank.argmax(1)
        able = rank[np.arange(len(active)), pick] > -np.inf
        final[active[~able], :] = length
        final[active[~able], : edges.shape[1]] = edges[~able]
        active, edges, pick, rank = active[able], edges[able], pick[able], rank[able]
        if not len(active):
            break
        # drop the edge between the merged pair, and only look again at the pairs it changes
        keep = np.arange(edges.shape[1])[None, :] != pick[:, None] + 1
        edges = edges[keep].reshape(len(active), -1)
        rank = rank[np.arange(rank.shape[1])[None, :] != pick[:, None]].reshape(len(active), -1)
        for shift in (-1, 0):
            j = pick + shift
            ok = (j >= 0) & (j < rank.shape[1])
            i, j = np.flatnonzero(ok), j[ok]
            found = _spans(table, active[i], edges[i, j], edges[i, j + 2])
            rank[i, j] = np.where(found >= 0, pieces.scores[found], -np.inf)
    if len(active):
        final[active, :] = length
        final[active, : edges.shape[1]] = edges
    mask = np.zeros((rows, length + 1), bool)
    np.put_along_axis(mask, final, True, 1)
    return mask[:, 1:]


def encode_kinds(units: list[str], pieces: Pieces, kinds: tuple[bool, ...] = (True, False)) -> list[list[np.ndarray]]:
    """For each kind the ids of every unit: of the greatest sum of scores (True), or by merges (False).

    Units of one length advance together and look up their substrings once for all kinds; one over ``LONG`` characters goes alone.
    """
    out = [[np.zeros(0, np.int32)] * len(units) for _ in kinds]
    lengths = np.array([len(u) for u in units])
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        together = 1 if n > LONG else max(1, BATCH * 8 // n)
        for lo in range(0, len(which), together):
            at = which[lo : lo + together]
            codes = np.frombuffer("".join(units[i] for i in at.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.int64)
            table = pieces.table(codes)
            for best, ids_of in zip(kinds, out, strict=True):
                if n > LONG:
                    mask = viterbi_long(table, pieces) if best else merge_long(table, pieces)
                else:
                    mask = viterbi(codes, pieces, table=table) if best else merge(codes, pieces, table)
                row, end = np.nonzero(mask)
                end = end + 1
                start = np.concatenate(([0], end[:-1]))
                start[np.concatenate(([True], row[1:] != row[:-1]))] = 0
                found = _spans(table, row, start, end)
                ids = np.where(found >= 0, pieces.ids[found], -1).astype(np.int32)
                first = np.searchsorted(row, np.arange(len(at) + 1))
                missing = np.zeros(len(at), bool)
                missing[row[ids < 0]] = True
                for k, i in enumerate(at.tolist()):
                    own = ids[first[k] : first[k + 1]]
                    if missing[k]:
                        parts = [[x] if x >= 0 else pieces.bytes[list(units[i][s:e].encode())].tolist() for x, s, e in zip(own.tolist(), start[first[k] : first[k + 1]].tolist(), end[first[k] : first[k + 1]].tolist(), strict=True)]
                        own = np.array([x for p in parts for x in p], np.int32)
                    ids_of[i] = own
    return out


def encode_units(units: list[str], pieces: Pieces, best: bool = True) -> list[np.ndarray]:
    """Ids of each unit: of the greatest sum of scores (``best``), or by merges."""
    return encode_kinds(units, pieces, (best,))[0]


class Units:
    """Ids of known units behind each other in one flat array."""

    def __init__(self):
        self.flat, self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, new: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in new], np.int64)
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
        self.length = np.concatenate((self.length, n))
        self.flat = np.concatenate((self.flat, *new))

    def of(self, at: np.ndarray) -> np.ndarray:
        n = self.length[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[at] - (ends - n), n) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)


class Codec:
    """Encodes through a bounded cache of units, with the ids of the best sum of scores and the model's own."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()
        self.size = np.array([len(t) for t in pieces.text], np.int64)
        self.raw = np.frombuffer(b"".join(pieces.text), np.uint8)
        self.raw_begin = np.cumsum(self.size) - self.size

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.best, self.own = Units(), Units()

    def encode_both(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text: of the best sum of scores, and the model's own (for a unigram model the same)."""
        units = [UNITS.findall(self.pieces.normalize(t)) for t in texts]
        if len(self.known) > CACHE:
            self.clear()
        new = list({u for us in units for u in us}.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            best, *own = encode_kinds(new, self.pieces, (True, False) if self.pieces.is_bpe else (True,))
            self.best.add(best)
            for ids in own:
                self.own.add(ids)
        at = [np.fromiter(map(self.known.__getitem__, us), np.int64, len(us)) for us in units]
        best = [self.best.of(x) for x in at]
        return best, [self.own.of(x) for x in at] if self.pieces.is_bpe else best

    def encode(self, texts: list[str], best: bool = False) -> list[np.ndarray]:
        return self.encode_both(texts)[0 if best else 1]

    def decode(self, ids) -> str:
        """Text of ids: pieces behind each other, without the leading space that encoding adds."""
        ids = np.asarray(ids, np.int64)
        n = self.size[ids]
        ends = np.cumsum(n)
        raw = self.raw[np.repeat(self.raw_begin[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes() if len(ids) else b""
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Pieces.load(path))
    return _CODECS[path]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = (), best: bool = False) -> DataFrame:
    """doc_id, the columns in ``keep`` and ids (array<int>) of every text; null or empty: no ids.

    ids are the model's own, or with ``best`` those with the greatest sum of piece scores. Repeated rows and equal or null
    doc_ids are encoded each by its text. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    names = ["doc_id", *keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches):
        own = codec(model)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids = own.encode([t or "" for t in part.column("text").to_pylist()], best)
                first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.ListArray.from_arrays(pa.array(first), pa.array(flat, pa.int32()))], names=[*names, "ids"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{types}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` with text decoded from ids; null ids give null."""
    names = encoded.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches):
        own = codec(model)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, f"{types}, decoded string")


def _digests(model: str):
    """(doc_id, text) -> number and checksum of the model's own ids and of the best ones, and the text that the best ones decode to."""

    def run(batches):
        codec_ = codec(model)
        crc = lambda ids: pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64())
        size = lambda ids: pa.array([len(x) for x in ids], pa.int64())
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                best, own = codec_.encode_both([t or "" for t in part.column("text").to_pylist()])
                decoded = pa.array([codec_.decode(x) for x in best], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size(own), crc(own), size(best), crc(best), decoded], names=["doc_id", "n_ids", "ids_crc32", "best_n_ids", "best_ids_crc32", "decoded"])

    return run


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, the model's own and those of the best sum of scores, digested, and the digest of the text decoded from the best."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = docs.mapInArrow(_digests(public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_ids long, ids_crc32 long, best_n_ids long, best_ids_crc32 long, decoded string")
    return out.select("doc_id", "n_ids", "ids_crc32", "best_n_ids", "best_ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))
