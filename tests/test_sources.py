"""Files of reads and of long records against plain parsers, in ranges of any size."""

import gzip
import random

import pytest

from strandlake.sources import fastq, fastx, ranges

RNG = random.Random(11)


def _reads(n, tricky=True):
    out = []
    for i in range(n):
        size = RNG.choice((0, 1, 4, 30, 200)) if tricky else 20
        qual = "".join(RNG.choice("@+I!") for _ in range(size))
        out.append((f"r{i}", "".join(RNG.choice("ACGTN") for _ in range(size)), "@" + qual[1:] if size and i % 2 else qual))
    return out


def _text(reads, end="\n", last="\n", notes=" some words"):
    return end.join(f"@{n}{notes}{end}{s}{end}+{n if i % 3 else ''}{end}{q}" for i, (n, s, q) in enumerate(reads)) + last.replace("\n", end)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fastq")
    parts = [_reads(60), _reads(1), _reads(40), _reads(25), [], [*_reads(9)[:8], ("z", "AC", "II")]]
    (d / "a.fq").write_bytes(_text(parts[0]).encode())
    (d / "b.fq").write_bytes((_text(parts[1], last="\n\n\n")).encode())
    (d / "c.fq").write_bytes(_text(parts[2], end="\r\n").encode())
    (d / "d.fq.gz").write_bytes(gzip.compress(_text(parts[3], last="\n\n").encode()))
    (d / "e.fq").write_bytes(b"")
    (d / "f.fq").write_bytes(_text(parts[5], last="").encode())
    (d / "_SUCCESS").write_bytes(b"")
    return d, [(i, *r) for p in parts for i, r in enumerate(p)]


def test_read_fastq_numbers_lines_inside_each_file(spark, folder):
    d, expected = folder
    found = fastx.read_fastq(spark, str(d)).orderBy("read_ix").collect()
    assert [tuple(r) for r in found] == [(i, *r[1:]) for i, r in enumerate(expected)]


@pytest.mark.parametrize("most", [64 << 20, 700, 90])
def test_fastq_source_in_ranges(spark, folder, most):
    d, expected = folder
    found = fastq.scan_fastq(spark, f"file://{d}", most).orderBy("read_ix").collect()
    assert [tuple(r) for r in found] == [(i, *r) for i, r in enumerate(expected)]
    assert len({r[0] for r in found}) == len(expected)


@pytest.mark.parametrize("most", [1, 3, 17, 64])
def test_every_range_finds_its_reads(tmp_path, most):
    for end in ("\n", "\r\n"):
        reads = _reads(40)
        path = tmp_path / f"x{len(end)}{most}.fq"
        path.write_bytes(_text(reads, end).encode())
        size = path.stat().st_size
        found = [f for lo in range(0, size, most) for f in fastq.frames(str(path), fastq.first_read(str(path), lo), min(lo + most, size))]
        assert [(h.split()[0].decode(), s.decode(), q.decode()) for _, h, s, q in found] == reads


def test_frames_that_do_not_say_where_they_begin(tmp_path):
    """Empty reads whose lines would fit at other places too: lines are counted from the file's start."""
    path = tmp_path / "y.fq"
    path.write_text("@a\n\n+\n\n" * 400)
    size = path.stat().st_size
    found = [f for lo in range(0, size, 50) for f in fastq.frames(str(path), fastq.first_read(str(path), lo), min(lo + 50, size))]
    assert len(found) == 400


@pytest.mark.parametrize("bad", ["@a\nAC\n+\nI\n", "@a\nAC\n+\nII\nAC\n", "a\nAC\n+\nII\n", "@a\nAC\n+\nII\n\n@b\nAC\n+\nII\n", "@a\nAC\nII\n+\n"])
def test_broken_frames_are_errors(spark, tmp_path, bad):
    (tmp_path / "a.fq").write_text("@x\nACGT\n+\nIIII\n")
    (tmp_path / "b.fq").write_text(bad)
    for read in (fastx.read_fastq, fastq.scan_fastq):
        with pytest.raises(Exception, match="no read of four lines|blank line"):
            read(spark, str(tmp_path)).collect()


def test_pairs_that_are_not_in_step_are_refused(spark, tmp_path):
    a, b = tmp_path / "a.fq", tmp_path / "b.fq"
    a.write_text("@r/1\nAC\n+\nII\n@s/1\nAC\n+\nII\n")
    b.write_text("@r/2\nGT\n+\nJJ\n@s/2\nGG\n+\nJJ\n")
    assert [tuple(r) for r in fastx.read_pairs(spark, str(a), str(b)).orderBy("read_ix").collect()] == [(0, "r/1", "AC", "II", "GT", "JJ"), (1, "s/1", "AC", "II", "GG", "JJ")]
    for text in ("@r/2\nGT\n+\nJJ\n", "@r/2\nGT\n+\nJJ\n@t/2\nGG\n+\nJJ\n"):
        b.write_text(text)
        with pytest.raises(Exception, match="not in step"):
            fastx.read_pairs(spark, str(a), str(b)).collect()


def test_stream_loses_and_repeats_nothing_over_restarts(spark, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    first, second, third, fourth = _reads(50), _reads(30), _reads(20), _reads(5)

    def run():
        rows = fastq.stream_fastq(spark, str(source), 300)
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.file.rsplit("/", 1)[1], r.place, r.name, r.seq, r.qual) for r in spark.read.parquet(str(out)).collect())

    def expected(*files):
        rows = []
        for name, reads in files:
            place = 0
            for i, (n, s, q) in enumerate(reads):
                rows.append((name, place, n, s, q))
                place += len(f"@{n} some words\n{s}\n+{n if i % 3 else ''}\n{q}\n")
        return sorted(rows)

    (source / "a.fq").write_text(_text(first))
    assert run() == expected(("a.fq", first))
    assert run() == expected(("a.fq", first))
    # a file that grows, caught in the middle of a read, and a new one
    whole = _text(first + second)
    (source / "a.fq").write_text(whole[:-25])
    (source / "b.fq.gz").write_bytes(gzip.compress(_text(fourth).encode()))
    again = run()
    done = sum(r[0] == "a.fq" for r in again)
    assert 50 < done < 80 and again == expected(("a.fq", (first + second)[:done]), ("b.fq.gz", fourth))
    (source / "a.fq").write_text(whole)
    (source / "c.fq").write_text(_text(third))
    assert run() == expected(("a.fq", first + second), ("b.fq.gz", fourth), ("c.fq", third))


def test_files_are_listed_by_name(tmp_path):
    for n in ("b", "a", "_x", ".y"):
        (tmp_path / n).write_text(n)
    assert [p.rsplit("/", 1)[1] for p, _ in ranges.listed(str(tmp_path))] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        ranges.listed(str(tmp_path / "none"))
