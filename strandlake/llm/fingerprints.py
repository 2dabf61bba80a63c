"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph is a line, one over ``MOST`` characters in slices; long lines can be cut further, by their content, into sentences and shorter pieces. A paragraph
becomes a 63-bit key: 43 bits of its hash and its length in 20 bits. A sketch has three tables of cells; each key is added
to one cell of each table, as a count, an XOR of keys and an XOR of check hashes. The sketches of two versions subtract
cell by cell; peeling cells that hold one key recovers the keys found in just one version. If peeling ends with cells
left, both versions are sketched again, with cells in proportion to their keys. The likeness of two fingerprints is the
share of characters (with one per paragraph) outside the recovered difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: cells of the published sketch; cells per key of both versions in the first retry, growth per further one; number of sizes;
#: rounds of peeling at most
CELLS, PER_KEY, GROWTH, SIZES, PEELS = 24, 32, 4, 3, 40
LENGTH_BITS = 20
#: characters of a paragraph at most
MOST = (1 << LENGTH_BITS) - 2
#: documents that one window group holds on average when the next document is looked up, and quantiles of doc_id
ROWS, CUTS = 256, 1024
#: the query cuts lines of more characters into sentences, and sentences of more into pieces that end where two letters say so
LONG_LINE, LONG_SENTENCE = 160, 320
SENTENCE, PIECE = r"(?<=[.!?]) ", r"(?<=[aeiou]) (?=[a-l])"


def paragraphs(text: Column, cut: bool = False) -> Column:
    """Lines of a text; with ``cut``, long ones in pieces. Where a piece ends depends on the characters there alone, so an edit changes few of them."""
    lines = F.split(text, "\n")
    # a key holds a length of 20 bits, so longer lines are cut at that many characters
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(p) - 1) / MOST), F.lit(0)).cast("int")), lambda i: F.substring(p, i * MOST + 1, F.lit(MOST)))
    lines = F.when(F.length(text) > MOST, F.flatten(F.transform(lines, slices))).otherwise(lines)
    if not cut:
        return lines
    whole = lambda p, most, pattern: F.when(F.length(p) > most, F.split(p, pattern)).otherwise(F.array(p))
    lines = F.flatten(F.transform(lines, lambda p: whole(p, LONG_LINE, SENTENCE)))
    return F.flatten(F.transform(lines, lambda p: whole(p, LONG_SENTENCE, PIECE)))


def paragraph_keys(text: Column, cut: bool = False) -> Column:
    """Sorted distinct paragraph keys. Equal paragraphs count once; an empty text has one empty paragraph."""
    return F.sort_array(F.array_distinct(F.transform(paragraphs(text, cut), lambda p: F.shiftleft(F.shiftrightunsigned(F.xxhash64(p), LENGTH_BITS + 1), LENGTH_BITS).bitwiseOR((F.length(p) + 1).cast("long")))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(key: Column, table: int, per_table: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(table)), per_table) + per_table * table


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(F.struct(value.alias("v"))), lambda s: body(s["v"])), 1)


def _added(cells: Column, start: Column) -> Column:
    """(n, k, x) after adding cells or entries."""
    return F.aggregate(cells, start, lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["x"].bitwiseXOR(e["x"]).alias("x")))


def _zero() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(c) for c in "nkx"))


def sketch(keys: Column, per_table: Column | int = CELLS // 3) -> Column:
    """Array of 3 * per_table cells (n, k, x)."""
    per_table = F.lit(per_table).cast("long") if isinstance(per_table, int) else per_table
    entries = F.transform(keys, lambda k: F.struct(F.lit(1).cast("long").alias("n"), k.alias("k"), _check(k).alias("x"), *(_cell(k, t, per_table).alias(f"c{t}") for t in range(3))))
    table = lambda e, t: F.transform(F.sequence(per_table * t, per_table * (t + 1) - 1), lambda c: _added(F.filter(e, lambda x: x[f"c{t}"] == c), _zero()))
    return _let(entries, lambda e: F.concat(*(table(e, t) for t in range(3))))


def _entries(keys: Column, per_table: Column, count) -> Column:
    """(c, n, k, x) of keys in the cells of the three tables; key and count are taken from an element by ``count``."""
    return F.flatten(F.transform(keys, lambda e: F.array(*(F.struct(_cell(count(e)[0], t, per_table).alias("c"), count(e)[1].cast("long").alias("n"), count(e)[0].alias("k"), _check(count(e)[0]).alias("x")) for t in range(3)))))


def _gathered(entries: Column) -> Column:
    """Cells (c, n, k, x) that are not empty, from entries or cells in any order: sorted, then each run of a cell added."""

    def summed(s):
        firsts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["c"] != F.element_at(s, F.greatest(i - 1, F.lit(1)))["c"]))
        ends = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(s) + 1)
        cells = _let(firsts, lambda f: F.transform(f, lambda i, j: F.struct(F.element_at(s, i)["c"].alias("c"), _added(F.slice(s, i, ends(f, j) - i), _zero()).alias("v"))))
        return F.transform(F.filter(cells, lambda c: (c["v"]["n"] != 0) | (c["v"]["k"] != 0)), lambda c: F.struct(c["c"].alias("c"), c["v"]["n"].alias("n"), c["v"]["k"].alias("k"), c["v"]["x"].alias("x")))

    return F.when(F.size(entries) == 0, entries).otherwise(_let(F.sort_array(entries), summed))


def fingerprint(cells: Column) -> Column:
    """A sketch as text: 26 hexadecimal digits a cell, in base 64."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(F.pmod(c["n"], F.lit(256))), 2, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["x"]), 8, "0"))), ""))), "\r\n", "")


def _peel(cells: Column, per_table: Column) -> Column:
    """(ok, diff): whether a subtracted sketch (its cells that are not empty) peels off whole, and the characters in the recovered keys."""
    mask = F.lit((1 << LENGTH_BITS) - 1)

    def pure(c):
        return (F.abs(c["n"]) == 1) & (c["x"] == _check(c["k"]))

    def round_(state, _):
        # keys with the sign of their count: distinct numbers are found by hashing
        single = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: c["k"] * c["n"]))

        # the keys are all there if they add up to what the first table holds
        held = _added(F.filter(state["cells"], lambda c: c["c"] < per_table), _zero())
        sums = lambda keys: _added(F.transform(keys, lambda e: F.struct(F.signum(e).cast("long").alias("n"), F.abs(e).alias("k"), _check(F.abs(e)).alias("x"))), _zero())

        def peeled(keys):
            found = F.aggregate(keys, state["diff"], lambda a, k: a + F.abs(k).bitwiseAND(mask))
            whole = F.struct(F.filter(state["cells"], lambda c: F.lit(False)).alias("cells"), found.alias("diff"), F.lit(True).alias("done"))
            return F.when(sums(keys) == held, whole).otherwise(rest(keys))

        def rest(keys):
            left = _gathered(F.concat(state["cells"], _entries(keys, per_table, lambda e: (F.abs(e), -F.signum(e)))))
            found = F.aggregate(keys, state["diff"], lambda a, k: a + F.abs(k).bitwiseAND(mask))
            return F.struct(left.alias("cells"), found.alias("diff"), F.lit(False).alias("done"))

        stuck = F.struct(state["cells"].alias("cells"), state["diff"].alias("diff"), F.lit(True).alias("done"))
        return F.when(state["done"], state).otherwise(_let(single, lambda keys: F.when(F.size(keys) == 0, stuck).otherwise(peeled(keys))))

    start = F.struct(cells.alias("cells"), F.lit(0).cast("long").alias("diff"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, round_, lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["diff"].alias("diff")))


def _subtract(a: Column, b: Column) -> Column:
    """Cells (c, n, k, x) that are not empty after subtracting sketch b from sketch a."""
    cells = F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x")))
    cells = F.transform(cells, lambda v, i: F.struct(i.cast("long").alias("c"), v["n"].alias("n"), v["k"].alias("k"), v["x"].alias("x")))
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["k"] != 0))


def difference(keys_a: Column, cells_a: Column, keys_b: Column, cells_b: Column) -> Column:
    """Characters of the paragraphs in just one version; the published sketches first, larger ones on failure.

    A larger sketch of one version less the other's is made at once: the keys of both go into one set of cells, those of
    the second with count -1. Empty cells are not stored, so what that costs depends on the keys, not on the cells, and a
    retry takes so many that one round of peeling mostly recovers all. What no size recovers is taken from the keys.
    """
    mask = F.lit((1 << LENGTH_BITS) - 1)
    every = F.size(keys_a) + F.size(keys_b)

    def retry(state, level):
        cells = (every * F.lit(PER_KEY) * F.pow(F.lit(GROWTH), level - 1)).cast("long")
        larger = lambda m: _peel(_gathered(F.concat(_entries(keys_a, m, lambda e: (e, F.lit(1))), _entries(keys_b, m, lambda e: (e, F.lit(-1))))), m)
        return F.when(state["ok"], state).otherwise(_let(F.ceil(cells / 3).cast("long"), larger))

    first = _peel(_subtract(cells_a, cells_b), F.lit(CELLS // 3).cast("long"))
    only = F.concat(F.array_except(keys_a, keys_b), F.array_except(keys_b, keys_a))
    exact = F.aggregate(only, F.lit(0).cast("long"), lambda a, k: a + k.bitwiseAND(mask))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SIZES - 1)), first, retry, lambda s: F.when(s["ok"], s["diff"]).otherwise(exact))


def likeness(keys_a: Column, cells_a: Column, keys_b: Column, cells_b: Column) -> Column:
    """1 - (characters of differing paragraphs) / (characters of all), 0 to 1."""
    mask = F.lit((1 << LENGTH_BITS) - 1)
    size = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + k.bitwiseAND(mask))
    total = (size(keys_a) + size(keys_b)).cast("double")
    return F.lit(1.0) - difference(keys_a, cells_a, keys_b, cells_b) / total


def _ranges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, h) with r1, r2, s: ranges of the order by descending doc_id (null last), then h, that ascend with it.

    Quantiles of doc_id, at most CUTS, bound the intervals r1; an interval is cut into parts of equal width. A doc_id that
    fills a quantile or more, and the rows without one, are cut by h instead, so that no range is hot.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    many = max(1, min(CUTS, (n - nulls) // ROWS))
    found = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(many)], 10_000)).first()[0] or []
    cuts = sorted(set(found))
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values)) if values else F.array(F.lit(0).cast("long"))
    steps = [1 << i for i in range(len(cuts).bit_length())][::-1]
    # the number of cuts up to doc_id, by halving
    at = F.aggregate(F.array(*map(F.lit, steps)) if steps else F.array(F.lit(1)), F.lit(0), lambda a, d: F.when((a + d <= len(cuts)) & (F.element_at(longs(cuts), F.least(a + d, F.lit(max(1, len(cuts))))) <= F.col("doc_id")), a + d).otherwise(a))
    rows = rows.withColumn("at", F.when(F.col("doc_id").isNotNull(), at).otherwise(-1))
    parts = max(1, -(-n // (many * ROWS)))
    low = F.get(longs(cuts), F.greatest(F.col("at") - 1, F.lit(0)))
    high = F.coalesce(F.get(longs(cuts), F.greatest(F.col("at"), F.lit(0))), low)
    times = F.get(longs([found.count(c) for c in cuts]), F.greatest(F.col("at") - 1, F.lit(0)))
    width = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    share = F.col("h").cast("double") / float(1 << 64) + 0.5
    hot = (F.col("at") > 0) & (F.col("doc_id") == low) & (times > 1)
    s = (
        F.when(F.col("doc_id").isNull(), F.floor(share * max(1, nulls // ROWS)))
        .when(hot, F.floor(share * times * parts))
        .otherwise(-F.floor((F.col("doc_id").cast("double") - low.cast("double")) / width * parts))
    )
    return rows.select("doc_id", "text", "h", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-F.col("at")).alias("r1"), F.when(hot, 1).otherwise(0).alias("r2"), s.cast("long").alias("s"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id; after the last, the first.

    The next one is looked up inside a range of some ROWS documents; the last of a range gets the first of the next range,
    from one row per range. Nulls: '' for a null text; null doc_ids come last. Equal and null doc_ids follow each other
    by a hash of the text, then by text.
    """
    rows = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
    key = ["r1", "r2", "s"]
    order = Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last(), "h", "text")
    inside = rows.withColumn("next_text", F.lead("text").over(order))
    heads = rows.groupBy(*key).agg(F.min_by("text", F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("d"), "h", "text")).alias("head"))
    # the next range of each: inside its interval, else the first of the next interval, and of the first after the last
    range_ = F.struct(*key)
    ranges = rows.select(*key).distinct()
    firsts = ranges.groupBy("r1").agg(F.min(range_).alias("first"))
    all_ = Window.orderBy("r1")  # a row per interval, at most CUTS + 2
    firsts = firsts.select("r1", F.coalesce(F.lead("first").over(all_), F.min("first").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    pairs = ranges.withColumn("next", F.lead(range_).over(Window.partitionBy("r1").orderBy("r2", "s"))).join(F.broadcast(firsts), "r1")
    pairs = pairs.select(range_.alias("own"), F.coalesce("next", "after").alias("next"))
    joined = pairs.join(heads.select(range_.alias("next"), "head"), "next").select("own.*", "head")
    return inside.join(joined, key, "left").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def fingerprints(docs: DataFrame, cut: bool = False) -> DataFrame:
    """Each document with the next one, edited and compared.

    Returns doc_id, text, edited_text, n_chars, fingerprint, edited_fingerprint, near_edited, near_next. Paragraphs are
    lines; with ``cut``, long ones in pieces. A null text is empty; two empty texts are alike (1.0). Alone in its table, a
    document is its own next one. Repeated rows, and equal or null doc_ids, are documents of their own. Other columns
    are left out, whatever their names. An empty table gives no rows.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited_text"))
    rows = rows.select("doc_id", "text", "edited_text", "n_chars", *(paragraph_keys(F.col(c), cut).alias(k) for c, k in (("text", "ka"), ("edited_text", "kb"), ("next_text", "kc"))))
    rows = rows.select("*", *(sketch(F.col(k)).alias(c) for k, c in (("ka", "ca"), ("kb", "cb"), ("kc", "cc"))))
    a, b, c = ((F.col(f"k{x}"), F.col(f"c{x}")) for x in "abc")
    return rows.select(
        "doc_id", "text", "edited_text", "n_chars", fingerprint(F.col("ca")).alias("fingerprint"), fingerprint(F.col("cb")).alias("edited_fingerprint"),
        likeness(*a, *b).alias("near_edited"), likeness(*a, *c).alias("near_next"),
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents, with long lines cut."""
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), cut=True)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
