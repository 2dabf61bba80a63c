"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule is a share of a text in thousandths with a path of cutoffs from loose to strict, fixed beforehand (``PATH``). At a level all
rules stand at their cutoffs of that level, and a text over any of them is rejected; levels are nested. Texts that a label
calls good are the holdout: of the m good ones in a stratum, a level rejects x. Were more than ``risk`` of the stratum's
good texts rejected, so few would show up with a chance of at most P(Binomial(m, risk) <= x), the exact lower tail. Levels
are tested in order at confidence ``delta`` over the number of strata (Bonferroni), and the first that fails ends the path
(fixed sequence, which needs no further correction). So with probability 1 - delta, in no stratum more than ``risk`` of the
good texts are lost. Strata with too few labels, or none, reject nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: part and whole of each rule, its loosest and strictest cutoff in thousandths
PATH = {
    "symbols": ("n_symbols", "word_chars", 300, 20),
    "marks": ("n_marks", "word_chars", 300, 20),
    "upper": ("n_upper", "word_chars", 700, 200),
    "dup_lines": ("n_dup_lines", "n_lines", 900, 400),
}
LEVELS = 20
#: share of good texts that may be rejected in a stratum, and the chance that this fails in any
RISK, DELTA = 0.05, 0.05
WINDOW = 8
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _twins(pairs: Column) -> Column:
    """Places p of sorted (v, p) whose v stands more than once."""

    def marked(s: Column) -> Column:
        beside = lambda j: F.coalesce(F.get(s, j)["v"] == F.get(s, j + 1)["v"], F.lit(False))
        places = F.transform(s, lambda x, j: F.when(beside(j) | ((j > 0) & beside(j - 1)), x["p"]))
        return F.filter(places, lambda p: p.isNotNull())

    return _let(F.sort_array(pairs), marked)


def _joined(step: int):
    """Of an array of hashes: each one together with the one ``step`` places on."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in runs of ``window`` words which the array holds twice or more, the first included.

    Runs are met by a 64-bit hash; those that meet are compared as they are.
    """

    def count(ws: Column) -> Column:
        # hashes of 1, 2, 4, ... words from each word on, then of two that overlap; beyond the end they are cut off
        hashes, have = F.transform(ws, lambda x: F.xxhash64(x)), 1
        while have < window:
            step = min(have, window - have)
            hashes, have = _let(hashes, _joined(step)), have + step
        hashes = F.slice(hashes, F.lit(1), F.size(ws) - (window - 1))

        def of(h: Column) -> Column:
            met = _twins(F.transform(h, lambda x, i: F.struct(x.alias("v"), i.alias("p"))))
            same = _twins(F.transform(met, lambda i: F.struct(F.array_join(F.slice(ws, i + 1, F.lit(window)), " ").alias("v"), i.alias("p"))))
            covered = _let(F.sort_array(same), lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, j - 1)))), F.lit(0), lambda a, x: a + x))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)

        return F.when(F.size(ws) < window, 0).otherwise(_let(hashes, of))

    return _let(words, count).cast("long")


def features(docs: DataFrame, keep: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """doc_id and the columns in ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_marks (``!?``) and n_upper (A-Z). A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(text)
    count = lambda these: (chars - F.length(F.translate(text, these, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    both = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    words = _let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, window).alias("again")))
    rows = docs.select("doc_id", *keep, words.alias("_words"), both.alias("_lines"), F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"), count("#*$%&|<>").alias("n_symbols"), count("!?").alias("n_marks"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"))
    return rows.select("doc_id", *keep, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"), F.col("_words.again").alias("n_repeat_words"), F.col("_lines.n").alias("n_lines"), "n_marks", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cutoffs(loose: int, strict: int, levels: int) -> list[int]:
    return [loose + (strict - loose) * i // (levels - 1) for i in range(levels)]


def level(path: dict = PATH, levels: int = LEVELS) -> Column:
    """The first level (from 1) whose cutoffs a text is over; levels + 1 if none. Whole numbers decide."""
    firsts = []
    for part, whole, loose, strict in path.values():
        passed = [F.when(1000 * F.col(part) <= c * F.col(whole), 1).otherwise(0) for c in cutoffs(loose, strict, levels)]
        firsts.append(sum(passed, F.lit(1)))
    return F.least(*firsts).cast("int")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, to some 1e-12."""
    y = n + 9
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(math.prod((n + i for i in range(1, 9)), start=F.lit(1.0)))


def lower_tail(m: Column, x: Column, p: float) -> Column:
    """P(Binomial(m, p) <= x); 1 where x is at least m p, which no level below one half can pass.

    The terms fall from x down, so the sum ends where they no longer count, after some 12 standard deviations.
    """
    m, x = m.cast("double"), x.cast("double")
    first = F.exp(_log_factorial(m) - _log_factorial(x) - _log_factorial(m - x) + x * math.log(p) + (m - x) * math.log1p(-p))
    terms = F.sequence(F.lit(0).cast("long"), F.least(x, 60 + 12 * F.sqrt(m * p)).cast("long"))
    add = lambda a, j: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * (x - j) * (1 - p) / ((m - x + j + 1) * p)).alias("t"))
    total = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), add, lambda a: a["s"])
    return F.when(x >= m * p, 1.0).otherwise(F.least(F.lit(1.0), first * total))


def certified(good: DataFrame, risk: float = RISK, delta: float = DELTA, levels: int = LEVELS) -> DataFrame:
    """(stratum, m, chosen): good texts of a stratum and its strictest certified level, 0 for none. good: (stratum, level) of each good text."""
    counts = good.groupBy("stratum", "level").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.sum("n").alias("m"), F.collect_list(F.struct("level", "n")).alias("by"))  # at most levels + 1 entries
    counts = materialize(counts, "strata")
    most = delta / max(1, counts.count())
    tested = counts.select("stratum", "m", "by", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("l"))
    lost = F.aggregate(F.filter("by", lambda b: b["level"] <= F.col("l")), F.lit(0).cast("long"), lambda a, b: a + b["n"])
    tested = tested.select("stratum", "m", "l", lost.alias("x"))
    tested = tested.select("stratum", F.col("m").alias("good"), F.when(lower_tail(F.col("m"), F.col("x"), risk) > most, F.col("l")).alias("failed"))
    return tested.groupBy("stratum").agg(F.first("good").alias("m"), (F.coalesce(F.min("failed"), F.lit(levels + 1)) - 1).alias("chosen"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: tuple[str, ...] = (), risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Documents with their features, base_failed, level, chosen (their stratum's) and kept.

    labels: (doc_id, quality); a text is good if any of its rows has quality 1, and counts once in its stratum however many
    copies it has. Null labels and ids do not count. A null stratum is one of its own. Good texts that fail the base rules
    say nothing about the cutoffs and do not count. Repeated rows are judged alike.
    """
    rows = docs.select("doc_id", "text", *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)), F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("text_key"))
    inner = tuple(f"_keep{i}" for i in range(len(keep)))
    rows = features(rows, ("stratum", "text_key", *inner)).withColumn("level", level()).withColumn("base_failed", base_failed())
    rows = materialize(rows, "quality")
    good = labels.where("quality = 1").select("doc_id").distinct()
    good = rows.where("not base_failed").select("doc_id", "stratum", "text_key", "n_words", "word_chars", "level").join(good, "doc_id", "left_semi")
    chosen = materialize(certified(good.select("stratum", "text_key", "n_words", "word_chars", "level").distinct(), risk, delta), "certified")
    rejected = F.col("base_failed") | (F.col("level") <= F.coalesce("chosen", F.lit(0)))
    # a row for each stratum: Spark broadcasts the stored table if it is small
    out = rows.join(chosen.select(F.col("stratum").alias("_of"), "chosen"), F.col("stratum").eqNullSafe(F.col("_of")), "left").withColumn("kept", ~rejected)
    return out.select("doc_id", *(F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_marks", "n_upper", "level", F.coalesce("chosen", F.lit(0)).alias("chosen"))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract query: all documents, strata by language."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level_sql() -> str:
    first = lambda part, whole, loose, strict: "1 + " + " + ".join(f"CASE WHEN 1000 * {part} <= {c} * {whole} THEN 1 ELSE 0 END" for c in cutoffs(loose, strict, LEVELS))
    return "least(" + ", ".join(first(*rule) for rule in PATH.values()) + ")"


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
ws AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
lw AS (SELECT r, i, {" || ' ' || ".join(f"lead(x, {j}) OVER o" for j in range(WINDOW))} AS v FROM ws WINDOW o AS (PARTITION BY r ORDER BY i)),
ww AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM lw WHERE v IS NOT NULL),
wp AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM ww WHERE c > 1),
ra AS (SELECT r, CAST(sum(least({WINDOW}, i - coalesce(before, i - {WINDOW}))) AS BIGINT) AS again FROM wp GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
f AS (
  SELECT d.r, doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(again, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(text) - length(translate(text, '!?', '')) AS BIGINT) AS n_marks,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d JOIN ln USING (r) LEFT JOIN ra USING (r)
),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST({_level_sql()} AS INTEGER) AS level FROM f),
g AS (SELECT DISTINCT lang, text, level FROM j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
m AS (SELECT lang, count(*) AS m, count(*) OVER () AS strata FROM g GROUP BY lang),
x AS (SELECT m.lang, m.m, strata, l, (SELECT count(*) FROM g WHERE g.lang IS NOT DISTINCT FROM m.lang AND g.level <= l) AS x FROM m, range(1, {LEVELS + 1}) t(l)),
p AS (
  SELECT *, CASE WHEN x >= m * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln({RISK}) + (m - i) * ln(1 - {RISK})))) END AS tail FROM x
),
c AS (SELECT lang, coalesce(min(l) FILTER (tail > {DELTA} / strata), {LEVELS + 1}) - 1 AS chosen FROM p GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR level <= coalesce(chosen, 0)) AS kept,
       n_lines, n_marks, n_upper, level, CAST(coalesce(chosen, 0) AS INTEGER) AS chosen
FROM j LEFT JOIN c ON c.lang IS NOT DISTINCT FROM j.lang
"""
