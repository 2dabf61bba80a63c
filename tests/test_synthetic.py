"""The synthetic code on texts of one byte a character and others."""

from pyspark.sql import functions as F

from strandlake.functions import kmer


def test_synthetic_of_any_characters(spark):
    texts = ["", "plain.\ntext", "a\0b.", "café\0", "ɏɐ", "你.\n\U0001f600", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", kmer.synthetic(F.col("text")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [None if t is None else "".join("N" if c in ".\n" else str(ord(c) & 3) for c in t) for t in texts]
