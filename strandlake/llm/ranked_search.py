"""Ranked lexical search by sort-based accumulation.

1. The items' terms are numbered; item blocks of at most ``PAIRS`` (item, term) pairs are searched one after another.
2. Documents are read once for a block: each gives its length and, for the block's terms, their numbers and occurrences.
   These postings are stored; document frequencies, the number of documents and of terms are sums over all of them.
3. A task takes the postings of its documents, slice by slice. Each posting meets the items that ask for its term: the
   matched (item, document, impact) entries are laid behind each other, radix sorted by one packed number of item and
   document, and summed by runs (``numpy.add.reduceat``). All entries of a document lie in its own task.
4. Each task keeps a heap of the best k sums of every item; the heaps' rows are range-partitioned by item, and a heap for
   each item selects the result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIN_LONG, TERM_BYTES, Words, drop, materialize, slices, word_hashes

#: (item, term) pairs of a block (an item alone may have more), and matched entries that are sorted at once
PAIRS, ENTRIES = 1 << 20, 1 << 21
#: documents whose postings are sorted at once, as far as the entries go, per packed number of 16 bits
PACKED = 1 << 16


def _asked(batches):
    """(item, text) -> distinct (item, h, check, size) of its terms."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            words = Words(data, offsets, lower=True, of=TERM_BYTES)
            check = word_hashes(data, words.start, words.end, lower=True, seed=1)
            item = batch.column("item").slice(lo, hi - lo).take(pa.array(words.text_of_word()))
            yield pa.RecordBatch.from_arrays([item, pa.array(words.hash.view(np.int64)), pa.array(check.view(np.int64)), pa.array(words.end - words.start)], names=["item", "h", "check", "size"])


def _postings(h: np.ndarray, check: np.ndarray, size: np.ndarray):
    """Documents (doc_id, text) -> (doc_id, n, terms, often): the terms of a sorted vocabulary, by their place in it.

    A word of up to eight bytes is told by hash and size; a longer one is compared by a second hash.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, lower=True, of=TERM_BYTES)
                at = np.minimum(np.searchsorted(h, words.hash), max(len(h) - 1, 0))
                known = np.flatnonzero((h[at] == words.hash) & (size[at] == words.end - words.start)) if len(h) else np.zeros(0, np.int64)
                long = known[size[at[known]] > 8]
                wrong = long[check[at[long]] != word_hashes(data, words.start[long], words.end[long], lower=True, seed=1)]
                known = np.setdiff1d(known, wrong, assume_unique=True)
                pair, often = np.unique(words.text_of_word()[known] * np.int64(max(len(h), 1)) + at[known], return_counts=True)
                text, term = np.divmod(pair, max(len(h), 1))
                ends = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, often))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(words.first)), *lists], names=["doc_id", "n", "terms", "often"])
                yield out.filter(pa.array(np.diff(words.first) > 0))

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers by their digits of 16 bits, the lowest first; numpy sorts these by radix."""
    order, shift, top = None, 0, int(keys.max()) if len(keys) else 0
    while order is None or top >> shift:
        digit = (keys >> shift).astype(np.uint16)
        by = np.argsort(digit if order is None else digit[order], kind="stable")
        order, shift = by if order is None else order[by], shift + 16
    return order


def accumulate(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts) of all items that ask for a posting's term: items[first[term] : first[term + 1]]."""
    many = first[term + 1] - first[term]
    end = np.cumsum(many)
    entry = np.arange(end[-1] if len(end) else 0) + np.repeat(first[term] - (end - many), many)
    if not len(entry):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    key, worth = items[entry] + np.repeat(doc * n_items, many), np.repeat(impact, many)
    order = radix_order(key)
    key = key[order]
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    doc, item = np.divmod(key[runs], n_items)
    return item, doc, np.add.reduceat(worth[order], runs)


class Best:
    """Heaps of the k best (score, least document order first) of each item."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def put(self, item, score: int, order: int, doc_id) -> None:
        heap = self.heaps.setdefault(item, [])
        row = (score, -order, doc_id)
        if len(heap) < self.k:
            heapq.heappush(heap, row)
        elif row[:2] > heap[0][:2]:
            heapq.heapreplace(heap, row)

    def rows(self) -> list[tuple]:
        """(item, rank, doc_id, score)"""
        return [(item, i + 1, doc_id, score) for item, heap in self.heaps.items() for i, (score, _, doc_id) in enumerate(sorted(heap, key=lambda r: (-r[0], -r[1])))]


def _weakness(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + ((90 n N) div L), in whole numbers of any size."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        return 10 + 90 * n * documents // max(total, 1)
    return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)


def _scored(weight: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, documents: int, total: int, k: int):
    """Stored postings -> (item, doc_id, score), the k best of each item in this task; item by number."""

    def run(batches):
        best, least = Best(k), np.ones(n_items, np.int64)  # a score has to be above 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n = batch.column("n").to_numpy()
            terms = batch.column("terms")
            ends = terms.offsets.to_numpy() - terms.offsets[0].as_py() if len(terms) else np.zeros(1, np.int64)
            term, often = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "often"))
            owner = np.repeat(np.arange(len(ids)), np.diff(ends))
            impact = weight[term] * (1_000_000_000 * often // (1000 * often + 8 * _weakness(n, documents, total)[owner]))
            entries = np.concatenate(([0], np.cumsum((first[term + 1] - first[term]) * (impact > 0))))[ends]
            term, impact, owner, ends = term[impact > 0], impact[impact > 0], owner[impact > 0], np.concatenate(([0], np.cumsum(impact > 0)))[ends]
            lo = 0
            while lo < len(ids):
                hi = int(np.searchsorted(entries, entries[lo] + ENTRIES, "right")) - 1
                hi = max(lo + 1, min(hi, lo + max(1, PACKED // n_items)))
                part = slice(int(ends[lo]), int(ends[hi]))
                item, doc, score = accumulate(owner[part] - lo, term[part], impact[part], first, items, n_items)
                keep = score >= least[item]
                item, doc, score = item[keep], doc[keep], score[keep]
                if len(item) > k * n_items // 2:  # the k best of the slice first, with all that tie with the last of them
                    by = np.lexsort((-score, item))
                    begin = np.searchsorted(item[by], item[by])
                    last = np.minimum(begin + k - 1, np.searchsorted(item[by], item[by], "right") - 1)
                    by = by[score[by] >= score[by][last]]
                    item, doc, score = item[by], doc[by], score[by]
                for i, d, s in zip(item.tolist(), doc.tolist(), score.tolist(), strict=True):
                    best.put(i, s, MIN_LONG if ids[lo + d] is None else ids[lo + d], ids[lo + d])
                for i in np.unique(item).tolist():
                    if len(best.heaps[i]) == k:
                        least[i] = best.heaps[i][0][0]
                lo = hi
        rows = best.rows()
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        item, _, doc_id, score = columns
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _selected(k: int):
    """Rows (item, doc_id, score) of whole items -> (item, rank, doc_id, score), by a heap for each item."""

    def run(batches):
        best = Best(k)
        for batch in batches:
            for item, doc_id, score in zip(*(batch.column(c).to_pylist() for c in ("item", "doc_id", "score")), strict=True):
                best.put(item, score, MIN_LONG if doc_id is None else doc_id, doc_id)
        rows = best.rows()
        item, rank, doc_id, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(rank, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "rank", "doc_id", "score"])

    return run


def _blocks(asked: DataFrame) -> DataFrame:
    """(item_id, item, block): items numbered inside blocks of about PAIRS pairs; a block holds whole items."""
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(1024)))
    # totals by part, then inside a part, so that no window holds all items
    base = sizes.groupBy("part").agg(F.sum("n").alias("all"))
    base = base.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))  # 1,024 rows
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("item_id")) - F.col("n")
    sizes = sizes.withColumn("inside", inside).join(F.broadcast(base), "part")
    sizes = sizes.withColumn("block", F.floor((F.col("base") + F.col("inside")) / PAIRS).cast("int"))
    return sizes.select("item_id", "block", (F.row_number().over(Window.partitionBy("block").orderBy("item_id")) - 1).cast("long").alias("item"))


def _search_block(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block; pairs: (item, h, check, size), so few that tasks can hold them."""
    asked = pairs.toPandas() if pairs.limit(1).count() else pd.DataFrame({"item": [], "h": [], "check": [], "size": []}, dtype="int64")
    term = asked[["h", "check", "size"]].drop_duplicates()
    h = term["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, check, size = h[order], term["check"].to_numpy().view(np.uint64)[order], term["size"].to_numpy()[order]
    place = np.searchsorted(h, asked["h"].to_numpy().view(np.uint64))
    by = np.argsort(place, kind="stable")
    items = asked["item"].to_numpy()[by]
    first = np.searchsorted(place[by], np.arange(len(h) + 1))
    n_items = int(items.max(initial=-1)) + 1
    postings = materialize(docs.mapInArrow(_postings(h, check, size), "doc_id long, n long, terms array<int>, often array<int>"), "postings")
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(h), np.int64)
    for row in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row for each term of the block
        held[row.t] = row.n
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in held.tolist()], np.int64)
    if not n_items:
        drop(postings)
        return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    found = postings.mapInArrow(_scored(weight, first, items, n_items, documents, total, k), "item long, doc_id long, score long")
    found = materialize(found, "found", (postings,))
    return found.repartitionByRange("item").mapInArrow(_selected(k), "item long, rank int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    docs: (doc_id, text), items: (item_id, text). Terms are runs of ASCII letters and digits and of what is not ASCII, A-Z
    lower-cased. Equal scores go by doc_id, a null one first; each row is a document of its own, so repeated rows all count
    and rank. Rows of one item_id are one item with all their terms; a null item_id is an item too. Null texts have no
    terms; an item that finds nothing has no row.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item"), "text").mapInArrow(_asked, "item long, h long, check long, size long")
    asked = materialize(asked.withColumnRenamed("item", "item_id").distinct(), "asked")
    numbered = materialize(_blocks(asked), "items")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = (numbered.agg(F.max("block")).first()[0] or 0) + 1
    out = None
    for b in range(blocks):
        mine = numbered.where(F.col("block") == b)
        pairs = asked.join(mine, asked["item_id"].eqNullSafe(mine["item_id"])).select("item", "h", "check", "size")
        found = _search_block(spark, docs, pairs, k).join(mine.select("item_id", "item"), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The contract query: all documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("text")}, '{_TERM}') AS w FROM documents),
t AS (SELECT r, unnest(w) AS term FROM d),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}')) AS term FROM benchmark)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, c),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // total AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
