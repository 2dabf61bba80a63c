"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-partitioned by length and met in buckets of similar length, the longest first. The longest of all
give every query a first lower bound of its k-th best product, which rises with what a task finds. In a bucket, that bound
over the query's length and the bucket's greatest length is a local cosine threshold: above one, the query skips the
bucket; when high, a few coordinates with the greatest query values must lie in the ranges that the threshold leaves
(coordinate pruning); else only vectors long enough are kept (length pruning). Surviving products are verified in exact
integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: candidates of a bucket, vectors that give first bounds, and bytes of a block of queries
BUCKET_ROWS, SEEDS, BLOCK_BYTES = 4096, 512, 1 << 25
#: local cosine threshold from which coordinates prune, and how many are looked at
COSINE, FOCUS = 0.4, 4


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with floor(1024 * x) components, one beyond 64 bits as the nearest long.

    Vectors null, or holding null or non-finite components, take no part, nor do rows with a null vec_id.
    """
    rows = pick(vectors, vec_id, embedding).select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("e")).where("e is not null and vec_id is not null")
    rows = rows.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * 1024)).alias("v"))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer products as longs, one beyond 64 bits as the nearest long.

    Doubles are exact where no partial sum can pass 2^53; Python's integers serve beyond 62 bits.
    """
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = _largest(queries) * _largest(candidates) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float, copy=False) @ candidates.astype(float, copy=False).T).astype(np.int64)
    if most < 2**62:
        return queries @ candidates.T
    whole = queries.astype(object) @ candidates.T.astype(object)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, x)) for x in row] for row in whole], np.int64).reshape(whole.shape)


def _largest(matrix: np.ndarray) -> float:
    return max(float(matrix.max()), -float(matrix.min()))


def _by_dimension(lists: pa.Array):
    """(places, matrix) of the vectors of each dimension but 0."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        own = lists if len(at) == len(lists) else lists.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Queries:
    """A block of queries of one dimension, with the best k found for each so far and the bound that a product has to reach."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, v: np.ndarray, k: int):
        self.row, self.vec_id, self.v, self.k = row, vec_id, v, k
        self.norm = np.sqrt((v.astype(float) ** 2).sum(1))
        self.floor = np.full(len(row), -np.inf)
        self.score, self.found = ([np.zeros(0, np.int64)] * len(row) for _ in range(2))

    def bucket(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Meet a bucket of candidates."""
        norm = np.sqrt((c.astype(float) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        c, ids, norm = c[order], ids[order], norm[order]
        unit = c / np.maximum(norm, 1e-12)[:, None]
        # products of a bucket are exact in doubles if its largest numbers say so; converted once then
        q = self.v
        if _largest(c) * _largest(q) * c.shape[1] < 2**53:
            q, c = q.astype(float), c.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = (self.floor <= 0) | (self.norm * norm[0] >= self.floor * (1 - 1e-9))
        for i in np.flatnonzero(reach).tolist():
            floor, keep = self.floor[i], slice(0, len(ids))
            if floor > 0:
                # vectors too short to reach the bound end the bucket
                n = int(np.searchsorted(-norm, -(floor / self.norm[i] * (1 - 1e-9)), "right"))
                cosine, keep = floor / (self.norm[i] * max(norm[0], 1e-12)) - 1e-9, slice(0, n)
                if cosine >= COSINE:
                    keep, u, angle = np.arange(n), q[i] / self.norm[i], np.arccos(min(1.0, cosine))
                    for f in np.argsort(-np.abs(u))[:FOCUS]:
                        at = np.arccos(np.clip(u[f], -1, 1))
                        low, high = np.cos(min(np.pi, at + angle)) - 1e-9, np.cos(max(0.0, at - angle)) + 1e-9
                        keep = keep[(unit[keep, f] >= low) & (unit[keep, f] <= high)]
            score, own = products(q[i : i + 1], c[keep])[0], ids[keep]
            good = own != self.vec_id[i]
            if np.isfinite(floor):
                good &= score.astype(float) >= floor - 1e-9 * abs(floor)  # the floor is rounded
            if good.any():
                score, own = np.concatenate((self.score[i], score[good])), np.concatenate((self.found[i], own[good]))
                best = np.lexsort((own, ~score))[: self.k]
                self.score[i], self.found[i] = score[best], own[best]
                if len(best) == self.k:
                    self.floor[i] = max(floor, float(self.score[i][-1]))

    def batch(self) -> pa.RecordBatch:
        n = [len(s) for s in self.score]
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        columns = (np.repeat(self.row, n), np.repeat(self.vec_id, n), flat(self.found), flat(self.score))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["row", "query_id", "vec_id", "score"])


def _meet(table: pa.Table, seeds: pa.Table, k: int):
    """Candidates sorted by length, the longest first -> the k best of the task for each query of the block."""

    def run(batches):
        of = {}
        rows, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
        for at, matrix in _by_dimension(table["v"].combine_chunks()):
            of[matrix.shape[1]] = Queries(rows[at], ids[at], matrix, k)
        seed_ids = seeds["vec_id"].to_numpy()
        for at, matrix in _by_dimension(seeds["v"].combine_chunks()):
            q = of.get(matrix.shape[1])
            if q is not None and len(at) >= k:  # seeds give a bound, no rows: each is met in its own task
                score = products(q.v, matrix).astype(float)
                score[q.vec_id[:, None] == seed_ids[at][None, :]] = -np.inf
                q.floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            for lo in range(0, len(ids), BUCKET_ROWS):
                part = lists.slice(lo, BUCKET_ROWS)
                for at, matrix in _by_dimension(part):
                    if matrix.shape[1] in of:
                        of[matrix.shape[1]].bucket(ids[lo + at], matrix)
        for q in of.values():
            yield q.batch()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k greatest inner products among candidates of other ids.

    queries, candidates: (vec_id, v) with integer components. Ties go to the smaller vec_id. Vectors of different
    dimension, or of none, have no product. Fewer than k candidates give all. Rows with a null vec_id take no part.
    Repeated query rows are queries of their own, each with its ranks; repeated candidate rows count each. A score beyond
    64 bits is given as the nearest long; ranks follow the scores given.

    Candidates are dealt once, by length, and stored; blocks of queries, bounded in bytes, pass over them one after another.
    """
    spark = queries.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    candidates = candidates.where("vec_id is not null and size(v) > 0").select("vec_id", "v", norm.alias("norm"))
    # equal lengths are dealt by id
    stored = materialize(candidates.repartitionByRange("norm", F.xxhash64("vec_id")).sortWithinPartitions(F.desc("norm")), "vectors")
    asked = materialize(queries.where("vec_id is not null and size(v) > 0").select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "queries")
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # the longest vectors, a fixed number of them, give each query a first bound
    longest = max(1, min(SEEDS, BLOCK_BYTES // (8 * (stored.agg(F.max(F.size("v"))).first()[0] or 1))))
    seeds = stored.orderBy(F.desc("norm"), "vec_id").limit(longest).select("vec_id", "v").toArrow()
    blocks = max(1, -(-n * dim * 8 // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        # at most some BLOCK_BYTES of queries
        table = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        found = stored.select("vec_id", "v").mapInArrow(_meet(table, seeds, k), "row long, query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The contract query: rows whose vec_id is divisible by 100 against all."""
    rows = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where("vec_id % 100 = 0"), rows)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) AND len(q.v) > 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
