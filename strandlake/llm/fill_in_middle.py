"""Fill-in-the-middle transformation by overlapping-chunk decomposition.

A text is n tokens: a run of other characters with the white space before it, or white space at the end. Whether a token
begins at a character is seen from it and the one before it, so texts are cut into chunks of ``CHUNK`` bytes, each read
together with the byte before it, and every chunk counts its own boundaries and characters. Prefix sums of the counts say
which chunk owns a token's first character; the two cuts of a text are routed to the chunks that own them, and only these
chunks are read again to find the exact place. Arrays of one block of chunks exist at a time, whatever a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: bytes of a chunk, and chunks that count at once
CHUNK, BLOCK = 1 << 12, 1 << 7
#: marks of prefix, suffix and middle
SENTINELS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _boundaries(data: np.ndarray, lo: int, hi: int, texts: np.ndarray) -> np.ndarray:
    """Mask over data[lo:hi]: where a token begins. texts: places where texts that are not empty begin, in order."""
    space = _SPACE[data[max(lo - 1, 0) : hi]]
    begins = np.zeros(hi - lo, bool)
    begins[lo == 0 :] = space[1:] & ~space[:-1]
    begins[texts[np.searchsorted(texts, lo) : np.searchsorted(texts, hi)] - lo] = True
    return begins


class Chunks:
    """Texts that lie behind each other in one buffer, as chunks that have counted their tokens and characters.

    n: tokens of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, block: int = BLOCK):
        self.data, self.offsets = data, offsets
        size = np.diff(offsets)
        self.texts = offsets[:-1][size > 0]
        number = -(-size // chunk)
        self.first = np.concatenate(([0], np.cumsum(number)))  # each text's first chunk
        self.begin = np.repeat(offsets[:-1] - self.first[:-1] * chunk, number) + np.arange(self.first[-1]) * chunk
        self.end = np.concatenate((self.begin[1:], [len(data)])) if len(self.begin) else self.begin
        tokens, chars = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int64)
        for at in range(0, len(self.begin), block):
            some = self.begin[at : at + block]
            lo, hi = int(some[0]), int(self.end[min(at + block, len(self.end)) - 1])
            tokens[at : at + block] = np.add.reduceat(_boundaries(data, lo, hi, self.texts), some - lo, dtype=np.int64)
            chars[at : at + block] = np.add.reduceat(data[lo:hi] & 0xC0 != 0x80, some - lo, dtype=np.int64)
        self.tokens, self.chars = (np.concatenate(([0], np.cumsum(x))) for x in (tokens, chars))
        self.n = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """(byte place in the buffer, characters before it in the text) of the end of a text's first ``rank`` tokens."""
        first, last = self.first[text], self.first[text + 1]
        if rank == 0:
            return int(self.offsets[text]), 0
        if rank == self.n[text]:
            return int(self.offsets[text + 1]), int(self.chars[last] - self.chars[first])
        token = self.tokens[first] + rank
        owner = int(np.searchsorted(self.tokens, token, "right")) - 1
        lo, hi = int(self.begin[owner]), int(self.end[owner])
        place = lo + int(np.flatnonzero(_boundaries(self.data, lo, hi, self.texts))[token - self.tokens[owner]])
        inside = int(np.count_nonzero(self.data[lo:place] & 0xC0 != 0x80))
        return place, int(self.chars[owner] - self.chars[first]) + inside


def _transformed(marks: tuple[str, str, str], kept: list[str]):
    """Rows (text, form, h1, h2, kept ones) -> kept ones with n, form, prefix_chars, middle_chars and output."""
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in batches:
            forms, h1, h2 = (batch.column(c).to_pylist() for c in ("_form", "_h1", "_h2"))
            for lo, hi, data, offsets in slices(batch.column("_text")):
                chunks, raw = Chunks(data, offsets), memoryview(data)
                output, before, middle = [], [], []
                for i in range(hi - lo):
                    begin, end, form = int(offsets[i]), int(offsets[i + 1]), forms[lo + i]
                    if form == "plain":
                        output.append(bytes(raw[begin:end]))
                        before.append(None), middle.append(None)
                        continue
                    n = int(chunks.n[i])
                    one, two = sorted((h1[lo + i] % (n + 1), h2[lo + i] % (n + 1)))
                    (a, a_chars), (b, b_chars) = chunks.cut(i, one), chunks.cut(i, two)
                    head, tail = (p, raw[begin:a]), (s, raw[b:end])
                    output.append(b"".join((*head, *tail, m, raw[a:b]) if form == "psm" else (*tail, *head, m, raw[a:b])))
                    before.append(a_chars), middle.append(b_chars - a_chars)
                columns = [batch.column(c).slice(lo, hi - lo) for c in kept]
                columns += [pa.array(chunks.n), batch.column("_form").slice(lo, hi - lo), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents (doc_id, text) cut in prefix, middle and suffix, the middle moved to the end.

    Returns doc_id, the columns in ``keep``, n (tokens), form, prefix_chars, middle_chars (null if plain) and output. ``rate``
    of 100 texts are transformed, of these ``suffix_first`` of 100 in the order suffix, prefix, middle (spm), the others
    prefix, suffix, middle (psm); the hash of seed and doc_id decides, so equal rows are treated alike and a null doc_id is
    hashed as an empty one. A null text is an empty one. Empty texts and those that contain a sentinel stay plain.
    """
    heads = {x[:1] for x in sentinels}
    if not all(sentinels) or len(set(sentinels)) < 3 or any(h in x[1:] for h in heads for x in sentinels) or len({len(x) for x in sentinels}) > 1:
        raise ValueError("sentinels must be three different strings of equal length, none holding another's first character further on")
    names, inner = ["doc_id", *keep], [f"_keep{i}" for i in range(len(keep) + 1)]
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(names, inner, strict=True)), text.alias("_text"), digest.alias("_digest"))
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    plain = (F.col("_text") == "") | (h[2] % 100 >= rate)
    for x in sentinels:
        plain = plain | F.col("_text").contains(x)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select(*inner, "_text", form.alias("_form"), h[0].alias("_h1"), h[1].alias("_h2"))
    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(names, inner, strict=True))
    out = rows.mapInArrow(_transformed(sentinels, inner), f"{types}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(*(F.col(n).alias(c) for c, n in zip(names, inner, strict=True)), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output, by its sentinels; each stands in it once, for texts that hold one are plain."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract query: all documents, half of them transformed."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS k, {", ".join(f"CAST('0x' || substr(s, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t),
v AS (
  SELECT *, CAST(len(k) AS BIGINT) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
w AS (SELECT doc_id, text, n, form, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m, array_to_string(k[b + 1:], '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""
