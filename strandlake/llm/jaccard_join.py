"""N-gram Jaccard join with a count-vector R-tree.

Shingle sets that link share a shingle among the first n - ceil(t n) + 1 of each set, in any order that all sets share
(prefix filtering, exact). Here shingles of rare words come first and hot shingles last, so few texts meet by chance. Texts that share such a shingle meet in a bucket, first with
their prefixes alone; those that share enough of them come again with their whole texts. There their
shingles are hashed into groups, the group counts are points of an R-tree, the sum of coordinate minima bounds the
overlap, and pairs that the bound does not exclude are verified on the whole sets. A bucket reports a spanning forest of
its links, not all pairs; connected components of all buckets' forests follow in Spark.

Exact copies meet once, by the hash of their text. A shingle shared by more than ``hot`` texts has its texts dealt over
many buckets, each with a common leader; texts that are not connected with the leader are then compared with all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, doc_order, materialize, mix, slices, text_key, tidy

GROUPS = 64
LEAF = 16
#: a shingle counted in at least this share of all texts is ordered last, of more than HOT_MOST the most frequent. The order
#: decides what is compared first, never what is found
HOT_SHARE, HOT_MOST = 0.0003, 1 << 16
#: words counted in at least this share of all places weigh in the order; at most (1 / share) words can
WORD_SHARE = 0.00001


def shingle_sets(words: Words, size: int, weight: np.ndarray | None = None):
    """Sorted distinct shingle hashes of each text, behind each other, and where each text's begin. Short texts: one shingle.

    With weights of the words, also the sum of the weights in each shingle (short texts: 0).
    """
    grams, good = words.grams(size)
    text = words.text_of_word()
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = counts[short].astype(np.uint64)
    for j in range(size - 1):
        has = counts[short] > j
        extra[has] = mix(extra[has] * np.uint64(0x9E3779B97F4A7C15) + words.hash[words.first[short[has]] + j])
    value, owner = np.concatenate((grams[good], extra)), np.concatenate((text[good], short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner, order = value[new], owner[new], order[new]
    first = np.searchsorted(owner, np.arange(len(counts) + 1))
    if weight is None:
        return value, first
    upto = np.concatenate(([0], np.cumsum(weight)))
    at = np.flatnonzero(good)
    heavy = np.concatenate((upto[at + size] - upto[at], np.zeros(len(short), np.int64)))
    return value, first, heavy[order]


def _often(parts: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values that stand at least ``least`` times, and how often."""
    known, n = np.unique(np.concatenate(parts), return_counts=True)
    return known[n >= least].view(np.int64), n[n >= least]


#: words of successive slices that are counted together
COUNTED = 1 << 20


def _sizes(size: int):
    """(doc_order, key, text) -> set size per row (kind 0), shingles (1) and words (2) frequent among some COUNTED words with their count there (hash in doc_order), and the number of these words (3)."""

    def rows(kind: int, order, key, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), order, key, pa.array(n.astype(np.int64))], names=["kind", "doc_order", "key", "n"])

    def counts(shingles: list[np.ndarray], words: list[np.ndarray]):
        n = sum(map(len, words))
        yield rows(3, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), np.array([n]))
        for kind, found in ((1, _often(shingles, 2)), (2, _often(words, max(2, WORD_SHARE * n)))):
            if len(found[0]):
                yield rows(kind, pa.array(found[0]), pa.nulls(len(found[0]), pa.int64()), found[1])

    def run(batches):
        shingles, seen = [], []
        for batch in batches:
            order, key = batch.column("doc_order"), batch.column("key")
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, lower=True)
                value, first = shingle_sets(words, size)
                yield rows(0, order.slice(lo, hi - lo), key.slice(lo, hi - lo), np.diff(first))
                shingles.append(value), seen.append(words.hash)
                if sum(map(len, seen)) >= COUNTED:
                    yield from counts(shingles, seen)
                    shingles, seen = [], []
        if seen:
            yield from counts(shingles, seen)

    return run


def _weights(common: np.ndarray, counts: np.ndarray, least: float):
    """Function from word hashes to weights: the logarithm of a word's count over the least one, in eighths; rarer words 0."""
    by = np.argsort(common)
    known, weight = common[by], (1 + 8 * np.log2(counts[by] / least)).astype(np.int64)

    def weigh(words: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[at] == words, weight[at], 0)

    return weigh


def _prefixes(size: int, threshold: int, hot: np.ndarray, weigh):
    """(key, text) -> (shingle, key, size of the set, place) for the prefix of each set; copies in a task once.

    The common order: by the weight of the words, rare ones first, then by hash. hot: shingles ordered last, hottest at the end.
    """
    place = np.argsort(hot)
    ordered = hot[place]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, lower=True)
                value, first, weight = shingle_sets(words, size, weigh(words.hash))
                n = np.diff(first)
                owner = np.repeat(np.arange(hi - lo), n)
                rank = weight.astype(np.uint64)
                if len(ordered) and len(value):
                    at = np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)
                    is_hot = ordered[at] == value
                    rank = np.where(is_hot, np.uint64(1 << 63) + place[at].astype(np.uint64), rank)
                by = np.lexsort((value, rank, owner))
                need = n - -(-threshold * n // 100) + 1
                for i, k in enumerate(keys[lo:hi].tolist()):
                    if k in seen:
                        need[i] = 0
                    elif len(seen) < 1_000_000:
                        seen.add(k)
                at = np.arange(len(value)) - np.repeat(first[:-1], n)
                inside = at < np.repeat(need, n)
                if inside.any():
                    yield pa.RecordBatch.from_arrays([pa.array(value[by][inside].view(np.int64)), pa.array(keys[lo:hi][owner[inside]]), pa.array(n[owner[inside]].astype(np.int32)), pa.array(at[inside].astype(np.int32))], names=["shingle", "key", "size", "at"])

    return run


class CountTree:
    """R-tree over group counts of sets: leaves of LEAF points sorted by set size, bounding boxes by their upper corner."""

    def __init__(self, value: np.ndarray, first: np.ndarray):
        self.size = np.diff(first)
        n = len(self.size)
        owner = np.repeat(np.arange(n), self.size)
        self.point = np.bincount(owner * GROUPS + (value % np.uint64(GROUPS)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)
        heavy = self.point.argmax(1)
        self.order = np.lexsort((heavy, self.size))
        sorted_points, sorted_sizes = self.point[self.order], self.size[self.order]
        at = np.arange(0, n, LEAF)
        self.leaf_upper = np.maximum.reduceat(sorted_points, at)
        self.leaf_low, self.leaf_high = np.minimum.reduceat(sorted_sizes, at), np.maximum.reduceat(sorted_sizes, at)
        top = np.arange(0, len(at), LEAF)
        self.top_upper = np.maximum.reduceat(self.leaf_upper, top)
        self.top_low, self.top_high = np.minimum.reduceat(self.leaf_low, top), np.maximum.reduceat(self.leaf_high, top)

    def near(self, i: int, threshold: int) -> np.ndarray:
        """Points that the bound does not exclude as partners of point i."""
        point, n = self.point[i], self.size[i]

        def able(upper, low, high):
            # overlap >= t/(100+t) * (both sizes) is needed; the sizes must be within t of each other
            fits = (high * 100 >= threshold * n) & (low * threshold <= 100 * n)
            fits[fits] = np.minimum(upper[fits], point).sum(1) * (100 + threshold) >= threshold * (n + low[fits])
            return fits

        top = np.flatnonzero(able(self.top_upper, self.top_low, self.top_high))
        leaf = (top[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaf = leaf[leaf < len(self.leaf_low)]
        leaf = leaf[able(self.leaf_upper[leaf], self.leaf_low[leaf], self.leaf_high[leaf])]
        j = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        j = self.order[j[j < len(self.size)]]
        return j[able(self.point[j], self.size[j], self.size[j])]


def link_forest(value: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component label of each set and a spanning forest of the links among the sets."""
    tree = CountTree(value, first)
    n = len(tree.size)
    label, members, links = np.arange(n), {i: [i] for i in range(n)}, []
    for i in np.argsort(tree.size, kind="stable").tolist():
        if not tree.size[i]:
            continue
        near = tree.near(i, threshold)
        mine = value[first[i] : first[i + 1]]
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            other = value[first[j] : first[j + 1]]
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= threshold * (len(mine) + len(other) - both):
                links.append((i, j))
                a, b = sorted((label[i], label[j]), key=lambda x: len(members[x]))
                moved = members.pop(a)
                label[moved] = b
                members[b] += moved
    return label, links


def _survivors(threshold: int, buckets: int):
    """Rows (bucket, key, size, tokens, places, useful) of one bucket -> (bucket, key) of texts with a partner that shares enough of the prefix.

    A set has at most (its size - needed overlap) shingles that the partner lacks. Of two prefixes, the one that ends first
    in the common order lies whole in the other's range, so all but that many of its shingles are shared; and up to the last
    shared shingle, neither prefix may hold more shingles that are not. A pair counts in the bucket of its first useful
    shared token only.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, size = table.column("key").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        tokens = table.column("tokens").combine_chunks()
        n = len(keys)
        first = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
        known, token = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        bucket = table.column("bucket")[0].as_py()
        routed = np.zeros(len(known), np.int8)
        routed[token[np.asarray(table.column("useful").combine_chunks().flatten(), bool)]] = 1
        routed[(routed == 1) & (np.mod(known, buckets) == bucket)] = 2
        place = table.column("places").combine_chunks().flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(first))
        by_token = np.argsort(token, kind="stable")
        posted, posted_place = owner[by_token], place[by_token]
        count = np.bincount(token)
        begin = np.cumsum(count) - count
        survives = np.zeros(n, bool)
        for i in range(n):
            own, own_place = token[first[i] : first[i + 1]], place[first[i] : first[i + 1]]
            own, own_place = own[count[own] > 1], own_place[count[own] > 1]
            if not len(own):
                continue
            c = count[own]
            at = np.repeat(begin[own] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            shared = np.bincount(posted[at], minlength=n)
            # places of the last shared shingle: prefixes are in the common order, so the last to be put stays
            here, there = np.zeros(n, np.int64), np.zeros(n, np.int64)
            here[posted[at]], there[posted[at]] = np.repeat(own_place, c), posted_place[at]
            goes = np.repeat(routed[own], c)
            use = np.flatnonzero(goes)[::-1]  # reversed: the first to be shared stays
            route = np.zeros(n, np.int8)
            route[posted[at[use]]] = goes[use]
            overlap = -(-threshold * (size[i] + size) // (100 + threshold))
            need = np.maximum(1, overlap + threshold * np.maximum(size, size[i]) // -100 + 1)
            fits = (route == 2) & (shared >= need) & (here + 1 - shared <= size[i] - overlap) & (there + 1 - shared <= size - overlap)
            fits[i] = False
            survives[i] = fits.any()
        kept = keys[survives]
        return pa.table({"bucket": pa.array([bucket] * len(kept), pa.int64()), "key": pa.array(kept, pa.int64())})

    return run


def _bucket_links(size: int, threshold: int):
    """Rows (bucket, leader, key, text) of one bucket -> (a, b) links; for a bucket with a leader also (key, null) if not connected with it."""

    def run(table: pa.Table) -> pa.Table:
        texts, keys, leads = table.column("text").combine_chunks(), table.column("key").to_numpy(), table.column("leader")
        parts, firsts = [], [np.zeros(1, np.int64)]
        for _, _, data, offsets in slices(texts):
            value, first = shingle_sets(Words(data, offsets, lower=True), size)
            parts.append(value)
            firsts.append(first[1:] + firsts[-1][-1])
        label, links = link_forest(np.concatenate(parts), np.concatenate(firsts), threshold)
        a, b = [keys[i] for i, _ in links], [keys[j] for _, j in links]
        leader = leads[0].as_py()
        if leader is not None:
            alone = keys[label != label[np.flatnonzero(keys == leader)[0]]].tolist()
            a, b = a + alone, b + [None] * len(alone)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "token": pa.array([table.column("token")[0].as_py()] * len(a), pa.int64())})

    return run


def components(links: DataFrame, name: str = "components", most: int = 60, drops: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(node, component) with the least node of each connected component of links (a, b), by alternating large and small stars.

    drops: tables that only ``links`` reads; they are deleted.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name, drops)
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where("a <> b").distinct(), name, (edges,))
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(a as decimal(38,0))"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError("components did not settle")


def _hot_buckets(hot: DataFrame, hot_size: int) -> DataFrame:
    """(token, key, n) of hot shingles -> (bucket, token, leader, key): each text once per shingle, and the leader in each bucket."""
    leader = hot.groupBy("token").agg(F.min("key").alias("leader"), F.max(F.ceil(F.col("n") * 2 / hot_size)).alias("parts"))
    dealt = hot.join(leader, "token").select("token", "leader", "key", F.expr("pmod(xxhash64(key), parts)").alias("part"))
    led = leader.select("token", "leader", F.col("leader").alias("key"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    return dealt.unionByName(led).distinct().select(F.xxhash64("token", "part").alias("bucket"), "token", "leader", "key", "part")


def _need(threshold: int):
    """Column of the least number of shingles that prefixes of linked sets share: of a set of ``size``, with partners of sizes from lo to hi.

    Linked sets of sizes a <= b share at least t (a + b) / (1 + t) - t b prefix shingles, the fewer the more the sizes
    differ. Of two texts, the partner's size is known.
    """
    t = threshold / 100
    size, other = F.col("size"), F.col("lo") + F.col("hi") - F.col("size")
    small = F.greatest(F.when(F.col("n") == 2, other).otherwise(F.col("lo")).cast("double"), size * t)
    large = F.least(F.when(F.col("n") == 2, other).otherwise(F.col("hi")).cast("double"), size / t)
    # the bound for partners up to the own size, and from it on
    below = (size + F.least(small, size)) * t / (1 + t) - size * t
    above = (size + F.greatest(large, size)) * t / (1 + t) - F.greatest(large, size) * t
    return F.when(small >= size, above).when(large <= size, below).otherwise(F.least(below, above)) - 1e-6


def _able(posts: DataFrame, threshold: int) -> DataFrame:
    """Posts (token, key, n, size, at, lo, hi) without texts that cannot link with any text of the token: they share too little with anyone."""
    need = _need(threshold)
    posts = posts.withColumn("k", F.count("*").over(Window.partitionBy("key"))).where(F.col("k") >= need)
    posts = materialize(posts.select("token", "key", "size", "at", "k"), "posts")
    # again with what is left; of two texts, neither can share more than the other
    ends = posts.groupBy("token").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("k").alias("least_k")).where("n >= 2")
    posts_left = posts.join(ends, "token").where(F.when(F.col("n") == 2, F.col("least_k")).otherwise(F.col("k")) >= need)
    return materialize(posts_left.select("token", "key", "n", "size", "at"), "posts", (posts,))


#: bits of a Bloom filter per value, and at most
BLOOM_BITS, BLOOM_MOST = 16, 1 << 27


def bloom(values: DataFrame):
    """Function from a long column to whether it may be among ``values`` (one column of longs): one bit each in a bitmap of bounded size.

    Larger inputs fill the bitmap and let more pass, never less; it only spares rows a shuffle.
    """
    spark = values.sparkSession
    name = values.columns[0]
    n = values.count()
    bits = 1 << min((max(n, 4096) * BLOOM_BITS).bit_length(), BLOOM_MOST.bit_length() - 1)
    at = F.pmod(F.xxhash64(F.col(name), F.lit(11)), F.lit(bits))
    words = values.select(F.shiftright(at, 6).alias("w"), at.alias("b"))
    words = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, int(b & 63)))").alias("m")).collect()
    table = np.zeros(bits >> 6, np.int64)
    if words:
        at_, mask = zip(*words, strict=True)
        table[np.array(at_)] = np.array(mask, np.int64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(b: pd.Series) -> pd.Series:
        b = b.to_numpy()
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    return lambda column: may(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(bits)))


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 80, hot: int = 5000, bucket_rows: int = 4000) -> DataFrame:
    """Document classes under links with 100 * intersection >= threshold * union of their ``size``-word shingle sets.

    Words are lower-cased (A-Z). Returns doc_id, n_shingles, component_id (least doc_id of the class). A text with fewer
    words is one shingle; one without words, or null, is empty and linked with nothing. A null doc_id counts as the
    least and gives a null component_id. Rows with equal doc_id are one node. threshold is a percentage.
    """
    rows = docs.select("doc_id", doc_order().alias("doc_order"), text_key(F.col("text")).alias("key"), "text")
    texts = rows.where("key is not null")
    sizes = materialize(rows.select("doc_order", "key", "text").mapInArrow(tidy(_sizes(size)), "kind int, doc_order long, key long, n long"), "sizes")
    own = sizes.where("kind = 0").drop("kind")
    reps = own.groupBy("key").agg(F.min("doc_order").alias("rep"), F.first("n").alias("n"))
    total = own.count()
    places = sizes.where("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def frequent(kind: int, least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        found = sizes.where(F.col("kind") == kind).groupBy("doc_order").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "doc_order").limit(most).collect()[::-1]
        return np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)

    last, _ = frequent(1, max(8, HOT_SHARE * total), HOT_MOST)
    least = max(8, WORD_SHARE * places)
    weigh = _weights(*frequent(2, least, int(1 / WORD_SHARE)), least)

    posts = texts.select("key", "text").mapInArrow(tidy(_prefixes(size, threshold, last, weigh)), "shingle long, key long, size int, at int").repartition("shingle").dropDuplicates(["shingle", "key"])
    # the texts of a shingle fall apart where sizes, in order, differ too much to link; most are alone then and end here
    by_size = Window.partitionBy("shingle").orderBy("size")
    posts = posts.withColumn("gap", F.when(F.lag("size").over(by_size) * 100 < F.col("size") * threshold, 1).otherwise(0))
    posts = posts.withColumn("chain", F.sum("gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    together = Window.partitionBy("shingle", "chain")
    posts = posts.withColumn("n", F.count("*").over(together)).withColumn("lo", F.min("size").over(together)).withColumn("hi", F.max("size").over(together)).where("n >= 2")
    posts = _able(posts.select(F.xxhash64("shingle", "chain").alias("token"), "key", "n", "size", "at", "lo", "hi"), threshold)
    # a shingle whose texts all share another one, the first of each, adds no pair; of shingles with the same texts one will do
    best = posts.groupBy("key").agg(F.min(F.struct("at", "token")).getField("token").alias("best"))
    sets = posts.join(best, "key").groupBy("token").agg(F.min("best").alias("lo"), F.max("best").alias("hi"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key))").alias("texts"))
    useful = sets.where("n >= 2 and (lo <> hi or lo = token)").groupBy("texts", "n").agg(F.min("token").alias("token")).select("token", F.lit(True).alias("useful"))
    posts = stored = materialize(posts.join(useful, "token", "left").withColumn("useful", F.coalesce("useful", F.lit(False))), "posts", (posts,))
    prefixes = posts.groupBy("key").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "token", "useful"))).alias("p"))
    prefixes = prefixes.select("key", "size", F.col("p.token").alias("tokens"), F.col("p.at").alias("places"), F.col("p.useful").alias("useful"))
    posts = posts.where("useful").select("token", "key", "n")
    n_rows = posts.count()
    buckets = max(1, -(-n_rows // bucket_rows))
    normal = posts.where(F.col("n") <= hot).select(F.expr(f"pmod(token, {buckets}L)").alias("bucket"), "key").distinct()
    normal = normal.join(prefixes, "key").groupBy("bucket").applyInArrow(_survivors(threshold, buckets), "bucket long, key long")
    normal = normal.select("bucket", F.lit(None).cast("long").alias("token"), F.lit(None).cast("long").alias("leader"), "key")
    led = _hot_buckets(posts.where(F.col("n") > hot), hot)
    schema = "a long, b long, token long"

    def linked(placed: DataFrame) -> DataFrame:
        placed = materialize(placed.join(reps.select("key", "rep"), "key"), "placed")
        # most texts are asked for by no bucket and stay where they are
        asked = bloom(placed.select("key").distinct())
        own = texts.select("doc_order", F.col("key").alias("k"), "text").where(asked(F.col("key")))
        with_text = placed.join(own, (F.col("rep") == F.col("doc_order")) & (F.col("key") == F.col("k")))
        return with_text.select("bucket", "token", "leader", "key", "text").groupBy("bucket").applyInArrow(_bucket_links(size, threshold), schema)

    has_hot = posts.where(F.col("n") > hot).limit(1).count() > 0
    links = found = materialize(linked(normal.unionByName(led.drop("part")) if has_hot else normal), "links")
    if has_hot:
        # texts that their bucket could not connect with the leader are compared with all texts of the shingle
        alone = links.where("b is null").select("token", F.col("a").alias("key")).distinct()
        parts = led.select("token", "part", "bucket").distinct()
        everyone = led.select("bucket", "token", F.lit(None).cast("long").alias("leader"), "key")
        again = alone.join(parts, "token").select("bucket", "token", F.lit(None).cast("long").alias("leader"), "key")
        few = parts.join(alone.select("token").distinct(), "token", "left_semi").select("bucket")
        more = everyone.join(few, "bucket", "left_semi").unionByName(again).distinct()
        links = links.where("b is not null").select("a", "b").unionByName(linked(more).select("a", "b"))
    ids = reps.select(F.col("key"), "rep")
    links = links.where("b is not null").select("a", "b").join(ids.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a repeated doc_id with several texts joins their classes
    several = own.where("n > 0").groupBy("doc_order").agg(F.countDistinct("key").alias("k")).where("k > 1").select("doc_order")
    tied = own.where("n > 0").join(several, "doc_order", "left_semi").join(reps.select("key", "rep"), "key").select(F.col("doc_order").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(tied), drops=(stored, found))
    named = own.join(reps.select("key", "rep"), "key").join(found, F.col("rep") == F.col("node"), "left").select("doc_order", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_order")).alias("component"))
    named = named.dropDuplicates(["doc_order", "key"])
    out = rows.select("doc_id", "doc_order", "key").join(named, ["doc_order", "key"], "left")
    component = F.coalesce("component", "doc_order")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(component != F.lit(-(1 << 63)), component).alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract query: four-word shingles at 0.85 over all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, threshold=85)
