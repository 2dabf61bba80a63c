"""FASTA and FASTQ files as DataFrames, plain or gzipped, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: records that one window group numbers
GROUP = 1 << 16


def numbered(rows: DataFrame, name: str, in_file: str | None = None) -> DataFrame:
    """A gapless number in file order, and if asked for one inside each file. rows: _path, _block, _n (increasing inside a block of a file).

    Blocks are counted first, so a file's rows are numbered block by block, in parallel.
    """
    sizes = rows.groupBy("_path", "_block").agg(F.count("*").alias("_c"))
    before = lambda window: (F.sum("_c").over(window) - F.col("_c")).cast("long")
    base = sizes.select("_path", "_block", before(Window.orderBy("_path", "_block")).alias("_base"), before(Window.partitionBy("_path").orderBy("_block")).alias("_own"))
    inside = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_n")) - 1
    rows = rows.withColumn("_i", inside).join(base, ["_path", "_block"])
    for column, start in ((name, "_base"), (in_file, "_own")):
        rows = rows.withColumn(column, (F.col(start) + F.col("_i")).cast("long")) if column else rows
    return rows


def _read(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.text(path, lineSep=separator)
    return rows.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_ix, name, description, seq) in file order; sequence lines are joined. Text before the first '>' is no record."""
    rows = _read(spark, path, "\n>")
    value = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index(value, "\n", 1)
    body = F.regexp_replace(F.expr("substring(v, length(h) + 1)"), "\\s", "")
    rows = rows.withColumn("v", value).withColumn("h", head).withColumn("seq", body).where((F.trim("h") != "") | (F.col("seq") != ""))
    name, rest = F.regexp_extract("h", r"^(\S*)", 1), F.trim(F.regexp_extract("h", r"^\S*\s+(.*)$", 1))
    return numbered(rows.select("_path", "_block", "_n", name.alias("name"), F.when(rest != "", rest).alias("description"), "seq"), "record_ix").select("record_ix", "name", "description", "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_ix, name, seq, qual): every four lines of a file are a read, files in order of their names.

    Lines are numbered inside their file, never split on '@', which qualities may hold. Blank lines behind a file's last
    read are none; four lines that are no read end the job with an error that names the file.
    """
    rows = numbered(_read(spark, path, "\n"), "_all", "line").select("_path", "line", F.regexp_replace("value", "\r$", "").alias("value"))
    rows = rows.withColumn("frame", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    part = lambda n: F.max(F.when(F.col("part") == n, F.col("value")))
    reads = rows.groupBy("_path", "frame").agg(part(0).alias("h"), F.coalesce(part(1), F.lit("")).alias("seq"), F.coalesce(part(2), F.lit("")).alias("plus"), F.coalesce(part(3), F.lit("")).alias("qual"))
    blank = F.concat("h", "seq", "plus", "qual") == ""
    # blank frames are none, but only behind the last read
    last = reads.where(~blank).groupBy("_path").agg(F.max("frame").alias("_last"))
    reads = reads.join(last, "_path").where(F.col("frame") <= F.col("_last"))
    whole = F.col("h").startswith("@") & F.col("plus").startswith("+") & (F.octet_length("seq") == F.octet_length("qual"))
    said = F.concat(F.lit("no read of four lines: read "), F.col("frame").cast("string"), F.lit(" of "), F.col("_path"))
    reads = reads.withColumn("h", F.when(whole, F.col("h")).otherwise(F.raise_error(said).cast("string")))
    files = last.select("_path", (F.sum(F.col("_last") + 1).over(Window.orderBy("_path")) - F.col("_last") - 1).alias("_base"))
    reads = reads.join(files, "_path")
    return reads.select((F.col("_base") + F.col("frame")).cast("long").alias("read_ix"), F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), "seq", "qual")


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(read_ix, name, seq, qual, mate_seq, mate_qual) of two FASTQ files in step.

    Files of different length, or reads and mates of different names (but for /1 and /2 at their ends), are an error.
    """
    plain = lambda c: F.regexp_replace(c, "/[12]$", "")
    mate = read_fastq(spark, second).select("read_ix", F.col("name").alias("_mate"), F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual"))
    both = read_fastq(spark, first).join(mate, "read_ix", "full_outer")
    said = F.concat(F.lit("files are not in step at read "), F.col("read_ix").cast("string"))
    name = F.when(plain("name") == plain("_mate"), F.col("name")).otherwise(F.raise_error(said).cast("string"))
    return both.select("read_ix", name.alias("name"), "seq", "qual", "mate_seq", "mate_qual")


def write_fasta(records: DataFrame, path: str, width: int = 60, compression: str = "none") -> None:
    """(record_ix, name, description, seq) as FASTA parts in record order, lines of ``width``."""
    head = F.concat_ws(" ", F.concat(F.lit(">"), "name"), "description")
    lines = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    ordered = records.repartitionByRange("record_ix").sortWithinPartitions("record_ix")
    ordered.select(F.concat_ws("\n", head, lines).alias("value")).write.option("compression", compression).text(path)


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    value = F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")
    reads.repartitionByRange("read_ix").sortWithinPartitions("read_ix").select(value.alias("value")).write.option("compression", compression).text(path)
