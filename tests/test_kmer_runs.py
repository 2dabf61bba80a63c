"""k-mers read from stored chunks in runs of bounded size, sorted inside."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.operators import packed


@pytest.mark.parametrize(("most", "batch"), [(1, 3), (50, 4), (200, 100), (1 << 22, 2)])
def test_runs_are_bounded_and_whole(monkeypatch, most, batch):
    monkeypatch.setattr(packed, "SORTED", most)
    monkeypatch.setattr(packed, "OUT", 40)
    rng, rows, expected, k = random.Random(12), [], [], 5
    for i in range(60):
        n = rng.choice([1, 4, 5, 30, 67])
        digits = [rng.randrange(4) for _ in range(n)]
        rows.append((i, i // 3, i % 3, i * 64, n, bytes(sum(d << 2 * j for j, d in enumerate(digits[a : a + 4])) for a in range(0, n, 4))))
        for j in range(min(n - k + 1, 64)):
            own = digits[j : j + k]
            expected.append((i // 3, i % 3, i * 64 + j + k, sum(d << 2 * x for x, d in enumerate(own)), sum((d ^ 2) << 2 * (k - 1 - x) for x, d in enumerate(own))))
    kinds = {"bin": pa.int64(), "record_ix": pa.int64(), "contig_ix": pa.int32(), "start": pa.int64(), "n": pa.int32(), "bases": pa.binary()}
    table = pa.table({c: pa.array([r[x] for r in rows], t) for x, (c, t) in enumerate(kinds.items())})
    runs = []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **kw: runs.append(len(x)) or real(x, **kw))
    out = list(packed._read_kmers(k, 64)(iter(table.to_batches(max_chunksize=batch))))
    assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == sorted(expected)
    assert max(len(b) for b in out) <= 40 and max(runs) <= most + 2 * 64
    if most == 1 << 22:
        assert len(runs) == 1
        dna = [v for b in out for v in b.column("dna").to_pylist()]
        assert dna == sorted(dna)
