"""Bases four to a byte: the codec, ranges and k-mers against whole strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import kmer
from strandlake.operators import contigs, marks, packed


def test_codec():
    rng = np.random.default_rng(1)
    for sizes in ([0], [1], [4, 0, 5, 3, 8], rng.integers(0, 40, 60).tolist()):
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        digits = rng.integers(0, 4, offsets[-1]).astype(np.uint8)
        data, at = packed.encode(digits, offsets)
        assert len(data) == at[-1] == sum(-(-n // 4) for n in sizes)
        codes = packed.decode(data)
        for i, n in enumerate(sizes):
            own = digits[offsets[i] : offsets[i + 1]]
            assert (codes[4 * at[i] : 4 * at[i] + n] == own).all()
            for j, base in enumerate(own.tolist()):
                assert data[at[i] + j // 4] >> 2 * (j % 4) & 3 == base


@pytest.mark.parametrize("size,overlap", [(16, 8), (16, 40), (4096, 256)])
def test_ranges_and_kmers_of_packed_chunks(spark, size, overlap):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(n)) for i, n in enumerate((0, 5, 300, 1000, 37))]
    found = contigs.contigs(contigs.coded(spark.createDataFrame([*enumerate(seqs)], "record_ix long, seq string"), "record_ix", "seq", kmer.strict)).persist()
    bases = "".join({"A": "0", "C": "1", "T": "2", "G": "3"}[c] for s in seqs for c in s if c != "N")
    ranges = []
    for r in found.collect():
        for _ in range(4):
            lo = r.twobit + rng.randrange(r.length)
            ranges.append((r.record_ix, r.contig_ix, lo, lo + rng.randrange(r.twobit + r.length - lo + 1)))
    ranges += [ranges[-1]] * 2 + [max(ranges, key=lambda x: x[3] - x[2])] * 2
    df = spark.createDataFrame(ranges, f"record_ix long, contig_ix {dict(found.dtypes)['contig_ix']}, lo long, hi long")
    stored = packed.pack(contigs.base_chunks(found, size, overlap)).persist()
    assert stored.where("octet_length(bases) <> ceil(n / 4)").count() == 0
    out = sorted((r.lo, r.hi, r.bases) for r in packed.range_scan(df, stored, size, overlap).collect())
    assert out == sorted((lo, hi, bases[lo:hi]) for _, _, lo, hi in ranges if lo < hi)
    for k in (1, 4, 9):
        expected = sorted(map(tuple, marks.kmers(found, k).select("record_ix", "contig_ix", "pos", "dna", "rc").collect()))
        assert sorted(map(tuple, packed.kmers(stored, k, size, overlap).collect())) == expected
    with pytest.raises(ValueError):
        packed.kmers(stored, overlap + 2, size, overlap)
    assert packed.pack(contigs.base_chunks(found.limit(0))).agg(F.count("*")).first()[0] == 0
