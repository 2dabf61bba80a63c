"""Contigs and chunks of records that come in pieces, so that neither a record nor a contig is ever one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .contigs import running_total


def runs(pieces: DataFrame, code) -> DataFrame:
    """(record_ix, contig_ix, twobit, genomic, at, digits): each run of bases in a piece, with its contig's number, its
    contig's start among all coded bases and in its record, and its own start among all coded bases.

    pieces: (record_ix, start, seq) without gaps. A run that goes on from the piece before belongs to the same contig.
    Numbers carry from piece to piece by windows over one short row a piece; sequences meet these by their place.
    """
    rows = pieces.select(F.col("record_ix").cast("long").alias("record_ix"), F.col("start").cast("long").alias("start"), code(F.col("seq")).alias("codes")).where("codes <> ''")
    found = F.regexp_extract_all("codes", F.lit("(N*)([0-3]+)"), F.lit(0))
    rows = rows.withColumn("found", found)
    n, last = F.length(F.translate("codes", "N", "")), F.length(F.ltrim(F.element_at("found", -1), F.lit("N")))
    ends = F.length(F.rtrim(F.col("codes"), F.lit("N")))
    meta = rows.select("record_ix", "start", n.cast("long").alias("n"), F.size("found").alias("count"), F.col("codes").rlike("^[0-3]").alias("joins"), F.col("codes").rlike("[0-3]$").alias("open"), F.when(F.size("found") > 0, F.struct(last.alias("length"), ends.alias("end"))).alias("last"))
    order = Window.partitionBy("record_ix").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    meta = meta.withColumn("goes_on", F.col("joins") & F.coalesce(F.lag("open").over(order), F.lit(False)))
    meta = meta.withColumn("bases", F.coalesce(F.sum("n").over(before), F.lit(0)))
    new = F.col("count") - F.col("goes_on").cast("int")
    begun = F.when(new > 0, F.struct((F.col("bases") + F.col("n") - F.col("last.length")).alias("twobit"), (F.col("start") + F.col("last.end") - F.col("last.length")).alias("genomic")))
    meta = meta.select("record_ix", "start", "n", "goes_on", "bases", F.coalesce(F.sum(new).over(before), F.lit(0)).alias("ahead"), F.last(begun, True).over(before).alias("carried"))
    # one short row a piece, stored, so that the pieces are read for these and for the digits alone
    meta = materialize(meta, "pieces")
    total = running_total(meta.groupBy("record_ix").agg(F.sum("n").alias("n")), F.col("n")).select("record_ix", "before")
    meta = meta.drop("n")
    rows = rows.join(meta.join(total, "record_ix"), ["record_ix", "start"])
    rows = rows.select("record_ix", "start", "goes_on", "bases", "ahead", "carried", "before", F.posexplode("found").alias("j", "piece"))
    rows = rows.withColumn("digits", F.ltrim(F.col("piece"), F.lit("N")))
    inside = Window.partitionBy("record_ix", "start").orderBy("j")
    length = F.length("digits")
    rows = rows.withColumn("own", F.col("bases") + F.sum(length).over(inside) - length).withColumn("place", F.col("start") + F.sum(F.length("piece")).over(inside) - length)
    carried = F.col("goes_on") & (F.col("j") == 0)
    contig = (F.col("ahead") + F.col("j") - F.col("goes_on").cast("int")).cast("int")
    twobit, genomic = (F.when(carried, F.col(f"carried.{c}")).otherwise(F.col(own)).cast("long") for c, own in (("twobit", "own"), ("genomic", "place")))
    return rows.select("record_ix", contig.alias("contig_ix"), (F.col("before") + twobit).alias("twobit"), genomic.alias("genomic"), (F.col("before") + F.col("own")).alias("at"), "digits")


def contig_rows(found: DataFrame) -> DataFrame:
    """(record_ix, contig_ix, twobit, genomic, length) of the contigs whose runs are given."""
    return found.groupBy("record_ix", "contig_ix", "twobit", "genomic").agg(F.sum(F.length("digits")).alias("length"))


def terminals(pieces: DataFrame, records: DataFrame, code) -> DataFrame:
    """(record_ix, twobit, genomic): the closing entry of each record, at its end; records without a sequence included."""
    codes = code(F.col("seq"))
    sums = pieces.groupBy("record_ix").agg(F.sum(F.length(F.translate(codes, "N", ""))).alias("n"), F.sum(F.length(codes)).alias("genomic"))
    rows = records.select("record_ix").join(sums, "record_ix", "left").select("record_ix", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("genomic", F.lit(0)).cast("long").alias("genomic"))
    return running_total(rows, F.col("n")).select("record_ix", (F.col("before") + F.col("n")).alias("twobit"), "genomic")


def cells(found: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """(record_ix, contig_ix, twobit, cell, own, before, part): each contig's bases cut at multiples of ``size`` among all coded bases.

    own is the coded place of the part's first own base; the part begins up to ``before`` bases ahead of it and ends up to
    ``after`` bases behind the cell, inside the contig. A run gives each cell what it needs, and a cell joins what it gets:
    at most size + before + after bases.
    """
    end = F.col("at") + F.length("digits")
    rows = found.select("record_ix", "contig_ix", "twobit", "at", "digits", F.explode(F.sequence(F.floor((F.col("at") - after) / size), F.floor((end - 1 + before) / size))).alias("cell"))
    first, last = F.greatest("at", F.col("cell") * size - before), F.least(F.col("at") + F.length("digits"), (F.col("cell") + 1) * size + after)
    rows = rows.select("record_ix", "contig_ix", "twobit", "cell", F.struct(first.alias("first"), F.substring("digits", (first - F.col("at") + 1).cast("int"), (last - first).cast("int")).alias("d")).alias("p"))
    rows = rows.groupBy("record_ix", "contig_ix", "twobit", "cell").agg(F.array_sort(F.collect_list("p")).alias("p"))
    rows = rows.select("record_ix", "contig_ix", "twobit", "cell", F.col("p")[0]["first"].alias("first"), F.array_join("p.d", "").alias("part"))
    rows = rows.withColumn("own", F.greatest("first", F.col("cell") * size))
    mine = (F.col("own") < (F.col("cell") + 1) * size) & (F.col("first") + F.length("part") > F.col("own"))
    return rows.where(mine).select("record_ix", "contig_ix", "twobit", "cell", "own", (F.col("own") - F.col("first")).cast("int").alias("before"), "part")
