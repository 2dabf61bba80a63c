"""Steps whose cost once grew faster than their input: how often tables are stored, what is stored, and how many tasks read."""

import random

from pyspark.sql import functions as F

from strandlake.functions import kmer
from strandlake.operators import mapping, slots
from strandlake.sources import fastq

ROWS = "kmer long, ext int, pos long, ori int, dup boolean, repetitive boolean"


def lists_of(seed, k, kmers, most):
    rng, out = random.Random(seed), []
    for v in sorted({0, 1, 4**k - 1, *(rng.randrange(4**k) for _ in range(kmers))}):
        n = rng.randint(1, most)
        out += [(v, i, p, rng.randrange(2), i < n - 1, rng.random() < 0.5) for i, p in enumerate(sorted(rng.sample(range(10_000), n)))]
    return out


def settled(lists, k):
    m, held, over, todo = {}, {}, [], [(r, r[1]) for r in lists]
    for r in lists:
        m[r[0]] = m.get(r[0], 0) + 1
    while todo:
        r, j = todo.pop()
        n = 1 << ((r[0] >> k | r[0]) & ((1 << k) - 1)).bit_count()
        if j >= (n >> 1 if r[0] == 4**k - 1 else n):
            over.append(r)
            continue
        ext = kmer.extension_number(r[0], j, k)
        s, rank = kmer.slot_number(r[0], ext, k), (-ext, r[2], r[3], r[0])
        other = held.get(s)
        if other is None or rank < other[0]:
            held[s] = (rank, r, j)
            todo += [(other[1], other[2] + m[other[1][0]])] if other else []
        else:
            todo.append((r, j + m[r[0]]))
    return sorted((s, r[0], -rank[0], *r[2:]) for s, (rank, r, _) in held.items()), sorted(over)


def test_settle_stores_two_tables_however_long_the_chains(spark, monkeypatch):
    stored, real = [], slots.materialize
    monkeypatch.setattr(slots, "materialize", lambda df, name: stored.append(name) or real(df, name))
    monkeypatch.setattr(slots, "TAIL", 0)
    k, lists = 6, lists_of(1, 6, 900, 9)
    expected, over = settled(lists, k)
    table, overflow = slots.settle(spark.createDataFrame(lists, ROWS), k)
    assert len(stored) == 2
    assert sorted(map(tuple, table.collect())) == expected and sorted(map(tuple, overflow.collect())) == over and over


def test_settle_in_several_blocks(spark):
    k, lists = 4, lists_of(2, 4, 30, 5)
    expected, over = settled(lists, k)
    df = spark.createDataFrame(lists, ROWS)
    table, overflow = slots.settle(df, k, block_bits=5)
    assert sorted(map(tuple, table.collect())) == expected and sorted(map(tuple, overflow.collect())) == over
    assert sorted(map(tuple, slots.settle(df, k, overflow=False)[0].collect())) == expected


def test_probe_stores_only_marks_whose_first_slot_is_taken(spark, monkeypatch):
    stored, real = {}, mapping.materialize
    monkeypatch.setattr(mapping, "materialize", lambda df, name: stored.setdefault(name, real(df, name)) if name == "read-marks" else real(df, name))
    k, lists = 6, lists_of(3, 6, 10, 3)
    table, overflow = slots.place(spark.createDataFrame(lists, ROWS), k)
    reads = spark.range(4**k).select(F.col("id").alias("record_ix"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("ori"), F.col("id").alias("kmer"))
    hits = mapping.probe_slots(reads, table, k, overflow)
    assert sorted((r.kmer, r.pos) for r in hits.collect()) == sorted((r[0], r[2]) for r in lists)
    assert 0 < stored["read-marks"].count() < 4**k // 8


def test_short_ranges_share_tasks(spark, tmp_path):
    rng, expected = random.Random(4), []
    for name, n in (("a.fastq", 1500), ("b.fastq", 2500)):
        reads = [(f"{name[0]}{i}", "ACGT" * rng.randint(0, 30)) for i in range(n)]
        (tmp_path / name).write_text("".join(f"@{r}\n{s}\n+\n{'#' * len(s)}\n" for r, s in reads))
        expected += [(len(expected) + i, i, r, s, "#" * len(s)) for i, (r, s) in enumerate(reads)]
    rows = fastq.scan_fastq(spark, str(tmp_path), 64)
    assert sorted(map(tuple, rows.collect())) == expected
    raw = spark.read.format("fastq").option("splitBytes", "64").load(str(tmp_path))
    assert raw.select("file", "block").distinct().count() > 2000 and raw.rdd.getNumPartitions() <= 2 * fastq.TASKS
