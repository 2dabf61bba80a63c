"""Records in pieces against the reader of whole rows."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import kmer
from strandlake.operators import contigs, marks, pieces
from strandlake.sources import fasta, fastx

RNG = random.Random(21)


def _seq(n, gaps=True):
    out = [RNG.choice("ACGT") for _ in range(n)]
    for _ in range(n // 90 if gaps else 0):
        at = RNG.randrange(n)
        out[at : at + RNG.randint(1, 30)] = "N" * len(out[at : at + RNG.randint(1, 30)])
    return "".join(out)


def _wrapped(seq, width, end="\n"):
    return end.join(seq[i : i + width] for i in range(0, len(seq), width)) + end


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fasta")
    (d / "a.fa").write_bytes((">c1 a long one\n" + _wrapped(_seq(5000), 60) + ">c2\n" + _wrapped(_seq(900), 61) + ">c3 none\n" + ">c4  two  words \n" + _seq(3000) + "\n").encode())
    (d / "b.fa").write_bytes((">d1\r\n" + _wrapped(_seq(700), 50, "\r\n") + ">d2 x>y\r\n\r\nNNNN\r\nACGT\r\n").encode())
    (d / "c.fa.gz").write_bytes(gzip.compress((">e1\n" + _wrapped(_seq(400), 60) + ">e2\nACGTNACGT").encode()))
    (d / "d.fa").write_bytes((">f1\n" + _wrapped("N" * 200 + _seq(300, False) + "N" * 100, 60) + ">f2 at the end").encode())
    return str(d)


@pytest.mark.parametrize("split,piece", [(64 << 20, 1 << 16), (300, 100), (97, 64)])
def test_pieces_equal_whole_records(spark, folder, split, piece):
    whole = {r.record_ix: r for r in fastx.read_fasta(spark, folder).collect()}
    records, parts = fasta.scan_fasta(spark, folder, split, piece)
    assert sorted(map(tuple, records.collect())) == sorted((r.record_ix, r.name, r.description) for r in whole.values())
    seqs, longest = {}, 0
    for r in parts.orderBy("record_ix", "start").collect():
        assert r.start == len(seqs.get(r.record_ix, ""))
        seqs[r.record_ix] = seqs.get(r.record_ix, "") + r.seq
        longest = max(longest, len(r.seq))
    assert seqs == {i: r.seq for i, r in whole.items() if r.seq} and longest <= piece


@pytest.mark.parametrize("most", [1, 2, 7, 40])
def test_every_range_of_bytes(tmp_path, most):
    path = tmp_path / "x.fa"
    for end in ("\n", "\r\n"):
        text = end.join(["; no record", ">a b c", "ACG", "T", "", ">b", ">c", "A>C", "GG T"]) + (end if most % 2 else "")
        path.write_bytes(text.encode())
        size, found = len(text), []
        for lo in range(0, size, most):
            for header, seq in fasta.pieces_of(str(path), lo, min(lo + most, size), 2):
                assert len(seq) <= 2
                if header is not None:
                    found.append([header, ""])
                if found:
                    found[-1][1] += seq.decode()
        assert found == [["a b c", "ACGT"], ["b", ""], ["c", "A>CGGT"]]


@pytest.mark.parametrize("split,piece,size", [(64 << 20, 1 << 16, 1 << 14), (300, 100, 64), (97, 33, 50)])
def test_contigs_and_marks_equal_those_of_whole_rows(spark, folder, split, piece, size):
    k, read_len, seed = 4, 9, 5
    codes = contigs.coded(fastx.read_fasta(spark, folder), "record_ix", "seq", kmer.strict)
    found = contigs.contigs(codes).persist()
    records, parts = fasta.scan_fasta(spark, folder, split, piece)
    own = pieces.runs(parts, kmer.strict).persist()
    assert sorted(map(tuple, pieces.contig_rows(own).collect())) == sorted(map(tuple, found.drop("digits").collect()))
    assert sorted(map(tuple, pieces.terminals(parts, records, kmer.strict).collect())) == sorted(map(tuple, contigs.terminals(codes).collect()))
    rows = pieces.cells(own, size, before=marks.halo(k, read_len)).withColumn("offset", F.col("own") - F.col("twobit"))
    assert rows.agg(F.max(F.length("part"))).first()[0] <= size + marks.halo(k, read_len)
    expected = sorted(map(tuple, marks.median_marks(found, k, read_len, seed).collect()))
    assert sorted(map(tuple, marks.marks_of_chunks(rows, k, read_len, seed).collect())) == expected
    found.unpersist(), own.unpersist()


def test_index_of_pieces_equals_that_of_rows(spark, folder, tmp_path):
    from strandlake.plans.index import Params, build_index, build_index_of_pieces, load_index

    params = Params(4000, 20, rep_max_dist=50)
    whole = build_index(fastx.read_fasta(spark, folder), params)
    records, parts = fasta.scan_fasta(spark, folder, 1000, 200)
    long = build_index_of_pieces(records, parts, params)
    for name in ("postings", "slots", "overflow", "repeats", "terminals"):
        assert sorted(map(tuple, getattr(long, name).collect())) == sorted(map(tuple, getattr(whole, name).collect())), name
    assert sorted(map(tuple, long.contigs.collect())) == sorted(map(tuple, whole.contigs.drop("digits").collect()))
    cut = lambda ix: sorted((r.bin, r.record_ix, r.contig_ix, r.start, r.n, bytes(r.bases)) for r in ix.bases.collect())
    assert cut(long) == cut(whole)
    assert long.reconstruct().where("not agrees").count() == 0 and long.postings.count() > 100
    long.save(str(tmp_path / "ix"))
    loaded = load_index(spark, str(tmp_path / "ix"))
    # a quarter of the bytes, but for what chunks share and fill up
    stored = loaded.bases.agg(F.sum(F.octet_length("bases")), F.sum(F.expr("ceil(n / 4)"))).first()
    assert stored[0] == stored[1]
    reads = spark.createDataFrame([(0, "".join(r.seq for r in parts.where("record_ix = 0").orderBy("start").collect())[1000:1200])], "read_ix long, seq string")
    assert loaded.map_reads(reads)[1].first().status == "mapped"


def test_repeated_record_numbers_are_refused(spark):
    from strandlake.plans.index import Params, build_index

    with pytest.raises(ValueError, match="record number 1"):
        build_index(spark.createDataFrame([(1, "ACGTACGT"), (1, "GGGG"), (None, "AC"), (None, "AC")], "record_ix long, seq string"), Params(250, 6))
