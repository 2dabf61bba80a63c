"""Rows that go out in an order in which their files are small."""

from itertools import groupby

from pyspark.sql import functions as F

import __spark_entry__


def test_locations_go_out_in_order(spark):
    rows = __spark_entry__.queries()["location_functions"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("part"), "packed").collect()
    parts = [[r.packed for r in own] for _, own in groupby(rows, lambda r: r.part)]
    assert rows and all(own == sorted(own) for own in parts)
