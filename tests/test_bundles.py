"""Marks that are dealt out in bundles come back whole, and take few bytes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandlake.operators import bundles


@pytest.mark.parametrize(("held", "opened"), [(1, 1), (7, 3), (1 << 20, 1 << 17)])
def test_bundles_give_back_all_marks(monkeypatch, held, opened):
    monkeypatch.setattr(bundles, "HELD", held)
    monkeypatch.setattr(bundles, "OPENED", opened)
    rng = random.Random(8)
    rows = [(rng.choice([0, 5, (1 << 32) - 1, rng.randrange(1 << 24)]), rng.choice([0, 1, (1 << 44) - 1, rng.randrange(1 << 30)]), rng.randrange(2), rng.choice([-(1 << 40), 3, 1 << 62])) for _ in range(500)]
    rows += rows[:20]
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int32() if c == "ori" else pa.int64()) for i, c in enumerate(("kmer", "pos", "ori", "more"))})
    made = list(bundles._bundles(bundles.by_kmer, 6, ("more",))(iter(table.to_batches(max_chunksize=90))))
    for b in made:  # a part holds all marks of its k-mers
        parts = {}
        for r in bundles._opened(("more",))([b]):
            assert len(r) <= max(opened, max(b.column("n").to_pylist()))
        for i in range(len(b)):
            for r in bundles._opened(("more",))([b.slice(i, 1)]):
                for v in r.column("kmer").to_pylist():
                    assert parts.setdefault(v, b.column("part")[i].as_py()) == b.column("part")[i].as_py() == bundles.by_kmer(r.column("kmer").to_numpy(), 6)[0]
    out = [tuple(r.values()) for r in (x for b in made for o in bundles._opened(("more",))([b]) for x in o.to_pylist())]
    assert sorted(out) == sorted((v, pos * 2 + ori, more) for v, pos, ori, more in rows)


@pytest.mark.parametrize("keep", [False, True])
def test_dealt_by_kmer(spark, keep):
    found = spark.range(5000).selectExpr("id % 97 AS kmer", "id * 3 AS pos", "int(id % 2) AS ori", "-id AS more")
    rows = bundles.dealt(found, "more", keep=keep).withColumn("task", F.spark_partition_id())
    assert sorted((r.kmer, r.place, r.more) for r in rows.collect()) == sorted((i % 97, i * 6 + i % 2, -i) for i in range(5000))
    assert rows.groupBy("kmer").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    assert bundles.dealt(found.limit(0), keep=keep).count() == 0


@pytest.mark.parametrize("name", ["location_functions", "posting_distances", "postings", "map_pairs"])
def test_no_mark_is_a_row_of_the_exchange(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(shiftright(key" not in plan
