"""Chains sorted by one number, what they carry and leave out, and searches that thin only the k-mers they ask for."""

import re

import __spark_entry__
import pytest

from strandlake.operators import mapping, marks


@pytest.fixture(scope="module")
def found(spark):
    """Marks with rows that share the high bits of their place, and a k-mer and places as large as they get."""
    rows = {(n % 7, 5, n * 37 % 4001, n % 2) for n in range(600)} | {(1, (1 << 32) - 1, (1 << 44) - 1 - 3 * n, 1) for n in range(50)}
    return spark.createDataFrame(sorted(rows), "record_ix long, kmer long, pos long, ori int").repartition(3)


def one_by_one(rows, max_dist):
    """(kept with the one before, left out) in order."""
    kept, gone = [], []
    for r in sorted(rows, key=lambda r: (r.kmer, r.pos, r.ori)):
        same = bool(kept) and kept[-1][0] == r.kmer
        if same and r.pos - kept[-1][1] <= max_dist:
            gone.append(r.record_ix)
        else:
            kept.append((r.kmer, r.pos, r.ori, kept[-1][1] if same else None, r.record_ix))
    return kept, gone


@pytest.mark.parametrize("max_dist", [0, 1, 20, 100, 10_000])
def test_chains_carry_and_leave_out(spark, found, max_dist):
    kept, gone = one_by_one(found.collect(), max_dist)
    rows = marks.chains(found, max_dist, "record_ix").collect()
    assert sorted((r.kmer, r.pos, r.ori) for r in marks.chains(found, max_dist).collect()) == [k[:3] for k in kept]
    assert sorted(((r.kmer, r.pos, r.ori, r.stored, r.record_ix) for r in rows), key=lambda r: r[:3]) == kept
    assert {r.record_ix: r.n for r in marks.dropped(found, max_dist).collect()} == {x: gone.count(x) for x in set(gone)}


@pytest.mark.parametrize("most", [0, 100])
def test_probe_marks_equals_probe_of_all_postings(spark, found, most):
    reads = spark.createDataFrame([(1, 5, 0, 5), (1, 9, 1, 77), (2, 3, 1, 5)], "record_ix long, pos long, ori int, kmer long")
    expected = mapping.probe(reads, marks.postings(found, 20)).collect()
    assert expected and sorted(map(tuple, mapping.probe_marks(reads, found, 20, most).collect())) == sorted(map(tuple, expected))


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_marks_are_not_looked_up_again(spark):
    assert not re.search(r"Window \[lag", plan(spark, "posting_distances"))
    assert "LeftAnti" not in plan(spark, "record_report")
    assert "LeftSemi" in plan(spark, "map_reads")
