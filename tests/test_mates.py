"""Pairs found block by block of postings: equal to the join of hits, and no hit is dealt out."""

import random
import re

import pytest

import __spark_entry__
from strandlake.operators import mapping, mates


@pytest.fixture(scope="module")
def tables(spark):
    """Contigs of 1 to 900 bases, postings of few k-mers (both strands at some places), and marks of reads and mates, some repeated."""
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(40):
        n = rng.choice([1, 7, 60, 900])
        rows.append((i // 3, i % 3, at, n))
        at += n
    found = spark.createDataFrame(rows, "record_ix long, contig_ix int, twobit long, length long").selectExpr("*", "twobit AS genomic")
    lists = []
    for record, contig, start, n in rows:
        for pos in rng.sample(range(start + 1, start + n + 1), max(1, n // 4)):
            lists += [(rng.choice([0, 5, (1 << 32) - 1, rng.randrange(40)]), 0, pos, ori, False, start) for ori in rng.choice([(0,), (1,), (0, 1)])]
    placed = spark.createDataFrame(lists, "kmer long, ext int, pos long, ori int, dup boolean, start long")
    marks = lambda n: spark.createDataFrame([(rng.choice([3, -4, 1 << 40, rng.randrange(9)]), 0, rng.choice([0, 5, (1 << 32) - 1, rng.randrange(40)]), rng.randrange(2)) for _ in range(n)], "record_ix long, pos long, kmer long, ori int")
    return found, placed, marks(30), marks(40)


@pytest.mark.parametrize(("max_dist", "size", "marks", "most"), [(0, 64, 1000, 1000), (30, 64, 7, 50), (200, 64, 1000, 1), (200, 1 << 16, 20, 1 << 22)])
def test_blocks_equal_the_join_of_hits(spark, tables, max_dist, size, marks, most):
    found, placed, reads, second = tables
    expected = mapping.pairs(mapping.probe(reads, placed), mapping.probe(second, placed), found, max_dist)
    out = mates.pairs_of_marks(reads, second, placed, found, max_dist, size, marks, most)
    assert out.dtypes == expected.dtypes
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(map(tuple, expected.collect())) and rows


def test_no_marks_give_no_pairs(spark, tables):
    found, placed, reads, second = tables
    assert mates.pairs_of_marks(reads, second.limit(0), placed, found, 30).count() == 0
    assert mates.pairs_of_marks(reads, second, placed.limit(0), found, 30).count() == 0


def test_hits_are_not_joined(spark):
    plan = __spark_entry__.queries()["map_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[(kmer|read_ix)", plan)
