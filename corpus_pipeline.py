"""A corpus pipeline of five stages, each an operator of strandlake.llm; the result of one is written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import jaccard_join, packing, pii, substring_dedup, toxicity
from strandlake.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame, text) -> DataFrame:
    """The columns of documents with a new text; n_chars is counted again."""
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the rejection threshold; one with a null or empty text has no toxic words and stays."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=("lang", "source", "n_chars")).where(F.col("severity") < toxicity.REJECT).select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five words, 0.8): that of the least doc_id, a null one first, then of the least hash.

    Texts are judged by themselves, also those under one doc_id or under none; a text without words is like no other.
    Rows of equal doc_id and text are one document; the one of the least other columns stays.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_node"))
    classes = jaccard_join.jaccard_components(rows.select(F.col("_node").alias("doc_id"), "text"), size=5, threshold=80)
    classes = classes.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    nodes = rows.groupBy("_node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    judged = materialize(nodes.join(classes, "_node"), "judged")
    least = judged.groupBy("component_id").agg(F.min(F.struct("doc_id", "_node")).alias("least")).select(F.col("least._node").alias("_node"), F.lit(True).alias("kept"))
    # rows that are told apart from others: of classes of several, and repeated ones; all others stay where they are
    many = judged.groupBy("component_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("component_id")
    special = judged.join(many, "component_id").join(least, "_node", "left").select("_node", "n", F.coalesce("kept", F.lit(False)).alias("kept"))
    special = materialize(special, "special")
    may = jaccard_join.bloom(special.select("_node"))
    rows = rows.withColumn("_special", may(F.col("_node")))
    met = rows.where("_special").drop("_special").join(special, "_node", "left").where("kept is null or kept")
    # only repeated rows meet
    again = met.where("n > 1").groupBy("_node").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rows.where("not _special").select(*COLUMNS).unionByName(met.where("n is null or n = 1").select(*COLUMNS)).unionByName(again)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that stand earlier; one left without words goes, an unchanged one stays as it is, also a null or empty one."""
    rows = substring_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    return _documents(rows, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a null text stays null and has null n_chars."""
    return _documents(pii.find_pii(docs, keep=("lang", "source")), F.col("redacted_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; a null or empty text is one piece, the end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", one_of_each_class), ("substring_dedup", drop_repeats), ("pii", redact), ("packing", pack)]

#: SQL cannot express the first stage, which fits a model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), name)
    return rows
