"""Short ranges found by their place among all coded bases alone."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandlake.operators import contigs, mapping, packed


def test_scan_at_equals_the_text(spark):
    rng = random.Random(6)
    rows, at, whole = [], 0, ""
    for i in range(60):
        digits = "".join(rng.choice("0123") for _ in range(rng.choice([1, 2, 9, 40, 700])))
        rows.append((i // 4, i % 4, at, digits))
        at, whole = at + len(digits), whole + digits
    found = spark.createDataFrame(rows, "record_ix long, contig_ix int, twobit long, digits string").withColumn("length", F.length("digits").cast("long"))
    stored = packed.pack(contigs.base_chunks(found, 64, 16))
    asked = [(hi, n) for hi in range(-3, at + 20) for n in (0, 1, 7, 16) if rng.random() < 0.4] * 2
    ranges = spark.createDataFrame(asked, "hi long, n long")
    out = packed.scan_at(ranges, F.col("hi") - F.col("n"), F.col("hi"), stored, 16, 64, 16).collect()
    ends = [(twobit, twobit + len(digits)) for _, _, twobit, digits in rows]
    expected = [(hi, n, whole[hi - n : hi] if n and any(a <= hi - n and hi <= b for a, b in ends) else None) for hi, n in asked]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    with pytest.raises(Exception, match="longer than 15 bases"):
        packed.scan_at(ranges, F.col("hi") - F.col("n"), F.col("hi"), stored, 15, 64, 16).collect()
    with pytest.raises(ValueError, match="overlap"):
        packed.scan_at(ranges, F.col("hi") - F.col("n"), F.col("hi"), stored, 17, 64, 16)


@pytest.mark.parametrize("name", ["base_range_scan", "reconstruct_check"])
def test_ranges_are_dealt_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "explode(sequence(" not in plan  # bins of contigs


def test_read_again_equals_reconstruct(spark):
    digits = "0123301201" * 3
    found = spark.createDataFrame([(0, 0, 0, 0, 30, digits), (1, 0, 32, 0, 30, digits)], "record_ix long, contig_ix int, twobit long, genomic long, length long, digits string")
    lists = spark.createDataFrame([(v, 0, pos, ori) for v in (57, 27, 108, 4) for pos in (0, 3, 4, 5, 30, 31, 33, 36, 40, 62, 63) for ori in (0, 1)], "kmer long, ext int, pos long, ori int")
    expected = mapping.reconstruct(lists, found, 4, packed.pack(contigs.base_chunks(found))).drop("ext").collect()
    rows = mapping.read_again(lists, packed.pack(contigs.base_chunks(found)), 4).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, map(tuple, expected))) and any(r.agrees for r in expected)
