"""How often files are read for the runs of records in pieces."""

from strandlake.functions import kmer
from strandlake.operators import pieces
from strandlake.sources import fasta


def test_pieces_are_read_for_the_digits_alone(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r0\nACGTNNAC\nGT\n>r1\nNNN\n>r2\nA.CG\n")
    found = pieces.runs(fasta.scan_fasta(spark, str(tmp_path), 7, 3)[1], kmer.strict)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 2  # the ranges' totals and the pieces
    rows = sorted((r.record_ix, r.contig_ix, r.twobit, r.genomic, r.length) for r in pieces.contig_rows(found).collect())
    assert rows == [(0, 0, 0, 0, 4), (0, 1, 4, 6, 4), (2, 0, 8, 0, 1), (2, 1, 9, 2, 2)]
