"""Sharding by sampled splitters.

Records are ordered by (hash of the text, document, tie), so copies of a text lie together and no key is hot: a group of
copies is cut between its documents like any other range. A size-weighted sample gives quantile boundaries; ranges that
turn out larger than twice their share are sampled again, more densely, and subdivided. Ranges are the unit of parallel
work; within one, running sums of sizes give each record its exact place among all bytes, and so its shard and slot.
Only keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_LONG, materialize

#: ranges per shard; the size-weighted sample has OVERSAMPLE draws a range. Both bound what reaches the driver.
RANGES, OVERSAMPLE, ROUNDS = 16, 16, 8
KEY = ["h", "d", "tie"]


def _sample(keys: DataFrame, draws: int, total: int, seed: int) -> list[tuple[tuple, float]]:
    """About ``draws`` keys, each kept with a chance in proportion to its size; the weight says how many bytes it stands for."""
    chance = F.col("size") * float(draws) / float(max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 30)) / float(1 << 30)
    rows = keys.where(draw < chance).select(*KEY, (F.col("size") / F.least(chance, F.lit(1.0))).alias("w")).collect()
    return sorted(((r.h, r.d, r.tie), r.w) for r in rows)


def _quantiles(sample: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    weight = np.cumsum([w for _, w in sample])
    if not len(weight):
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return [sample[i][0] for i in at.tolist()]


def _range_of(bounds: list[tuple]):
    first = np.array([b[0] for b in bounds], np.int64)

    def find(h: pd.Series, d: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
        for i in np.flatnonzero(low != high).tolist():  # its hash is a boundary's
            low[i] = bisect.bisect_right(bounds, (h.iat[i], d.iat[i], tie.iat[i]), low[i], high[i])
        return pd.Series(low.astype(np.int32))

    return F.pandas_udf(find, "int")


def _measured(keys: DataFrame, bounds: list[tuple]) -> tuple[DataFrame, list]:
    placed = keys.withColumn("range", _range_of(bounds)(*KEY)) if bounds else keys.withColumn("range", F.lit(0))
    return placed, placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()


def shard(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows into ``shards`` shards of nearly equal bytes (law ``bytes``).

    Returns doc_id, the columns in ``keep``, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless in
    each shard). A null text has no bytes. Null and repeated doc_ids and repeated rows are ordinary records; equal rows
    are told apart by a tie number. A text larger than a shard's share makes that shard larger. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keys = materialize(
        docs.select(
            "doc_id", *keep, (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("d"), F.monotonically_increasing_id().alias("tie"),
        ), "shard-keys",
    )
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    parts = shards * RANGES
    bounds = _quantiles(_sample(keys, parts * OVERSAMPLE, total, 0), parts)
    share = max(1, total // parts)
    placed, sizes = _measured(keys, bounds)
    for k in range(1, ROUNDS):
        over = [r for r in sizes if r["size"] > 2 * share and r["n"] > 1]
        if not over:
            break
        many = placed.where(F.col("range").isin([r["range"] for r in over]))
        inside = sum(r["size"] for r in over)
        sample = _sample(many.select(*KEY, "size"), -(-inside * OVERSAMPLE * 2**k // share), inside, k)
        by_range: dict[int, list] = {}
        for x in sample:
            by_range.setdefault(bisect.bisect_right(bounds, x[0]), []).append(x)
        more = [q for r in over for q in _quantiles(by_range.get(r["range"], []), 1 + r["size"] // share)]
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
        placed, sizes = _measured(keys, bounds)
    before, base = 0, []
    for r in sorted(sizes, key=lambda r: r["range"]):
        base.append((r["range"], before))
        before += r["size"]
    spark = docs.sparkSession
    run = Window.partitionBy("range").orderBy(*KEY)
    starts = F.broadcast(spark.createDataFrame(base, "range int, base long"))  # a row for each range, whose number is bounded
    middle = F.col("base") + F.sum("size").over(run) - F.col("size") / 2
    cut = placed.join(starts, "range").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int")))
    cut = cut.withColumn("place", F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)))
    counts = sorted(cut.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    offset, seen = [], {}
    for s, r, n in counts:
        offset.append((s, r, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    offsets = F.broadcast(spark.createDataFrame(offset, "shard int, range int, offset long"))
    return cut.join(offsets, ["shard", "range"]).select("doc_id", *keep, "size", "text_crc32", "shard", (F.col("place") - 1 + F.col("offset")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write texts into one folder per shard, in slot order, and return the placement. doc_id must tell the rows apart."""
    placed = materialize(shard(docs, shards), "placed")
    joined = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract query: shards 0 to 7 by the law ``bytes``."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
