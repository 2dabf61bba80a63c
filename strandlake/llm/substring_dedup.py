"""Substring dedup with repeated-phrase automata.

1. Every window of ``window`` words selects the 8-word phrase with the least hash in it (the leftmost of equals), so equal
   windows select equal phrases. Phrases selected at two places or more recur; all others are dropped by a count.
2. The words of each recurring phrase are read from one document that holds it.
3. Documents are dealt into buckets of some ``BUCKET`` bytes, where they meet the words of all recurring phrases of their
   bucket. A bucket compiles them into Aho-Corasick automata, shards of at most ``SHARD`` phrases, and streams all its
   texts through each: what the automata find is where the passages are.
4. Windows whose selected phrase was found are compared by 128 bits of hash over all documents; each but the earliest is repeated.
5. Words covered by a repeated window are removed.

Exact copies of a text are judged once: the copy with the smallest doc_id stands for all, the others are repeated whole.
Each batch compares its own phrases and windows first and sends one row of equals to meet the other batches' by hash, so
a passage in a third of all documents is no hot key.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, doc_order, materialize, mix, sliding_min, slices, text_key, tidy, word_hashes

#: words of a phrase, phrases of one automaton, and bytes of text in a bucket on average
PHRASE, SHARD, BUCKET = 8, 8_192, 1 << 18


def _selected(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes; starts of the windows that lie in one text; the place of the phrase that each selects."""
    phrases, _ = words.grams(PHRASE)
    _, place = sliding_min(phrases, window - PHRASE + 1)
    n = len(words.hash)
    good = np.flatnonzero(np.arange(n) + window <= words.first[1:][words.text_of_word()]) if n else np.zeros(0, np.int64)
    return phrases, good, place[good] if len(good) else np.zeros(0, np.int64)


def _phrases(window: int):
    """(text, key) -> (part, sure, phrase, key, n): selected places of each phrase in each text, copies in a task once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                phrases, starts, places = _selected(words, window)
                if not len(starts):
                    continue
                places = np.unique(places)
                text = np.searchsorted(words.first, places, "right") - 1
                fresh = np.zeros(hi - lo, bool)
                for i, k in enumerate(keys[lo:hi].tolist()):
                    if k not in seen:
                        fresh[i] = True
                        if len(seen) < 1_000_000:
                            seen.add(k)
                use = fresh[text]
                pairs = np.stack([text[use], phrases[places[use]].view(np.int64)], 1)
                if not len(pairs):
                    continue
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1))))
                n = np.minimum(np.diff(np.concatenate((new, [len(pairs)]))), 2)
                key, phrase = keys[lo:hi][pairs[new, 0]], pairs[new, 1]
                # a phrase that recurs here needs one row for the count; its others are sure and dealt anywhere
                _, head, which = np.unique(phrase, return_index=True, return_inverse=True)
                total = np.bincount(which, n)
                sure = total[which] >= 2
                sure[head] = False
                n[head] = np.minimum(total, 2)
                part = np.where(sure, mix((key ^ phrase).view(np.uint64)).view(np.int64), phrase)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sure), pa.array(phrase), pa.array(key), pa.array(n.astype(np.int32))], names=["part", "sure", "phrase", "key", "n"])

    return run


def _rows_of(table: pa.Table) -> list[tuple[int, int]]:
    return list(zip(table.column("doc_order").to_pylist(), table.column("key").to_pylist(), strict=True))


def _spoken(window: int):
    """Texts and the phrases (doc_order, key, phrase) that some are asked for -> (phrase, words), the words joined by a space."""

    def run(_, texts: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[int, str] = {}
        wanted: dict[tuple[int, int], set[int]] = {}
        for row, phrase in zip(_rows_of(asked), asked.column("phrase").to_pylist(), strict=True):
            wanted.setdefault(row, set()).add(phrase)
        at = [i for i, row in enumerate(_rows_of(texts)) if row in wanted]
        rows = _rows_of(texts)
        own = texts.column("text").take(pa.array(at, pa.int64()))
        for lo, hi, data, offsets in slices(own):
            words = Words(data, offsets)
            hashes, _, places = _selected(words, window)
            places = np.unique(places)
            text = np.searchsorted(words.first, places, "right") - 1
            raw = data.tobytes()
            for place, i, h in zip(places.tolist(), text.tolist(), hashes[places].view(np.int64).tolist(), strict=True):
                if h not in out and h in wanted[rows[at[lo + i]]]:
                    out[h] = b" ".join(raw[a:b] for a, b in zip(words.start[place : place + PHRASE].tolist(), words.end[place : place + PHRASE].tolist(), strict=True)).decode()
        return pa.table({"phrase": pa.array(list(out), pa.int64()), "words": pa.array(list(out.values()), pa.string())})

    return run


def _automata(phrases: list[str]):
    """Aho-Corasick automata of the phrases, SHARD of them in each, over bytes as Latin-1; a hit gives the phrase's length."""
    for at in range(0, len(phrases), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in phrases[at : at + SHARD]:
            phrase = f" {phrase.encode().decode('latin-1')} "
            automaton.add_word(phrase, len(phrase))
        automaton.make_automaton()
        yield automaton


def locate(words: Words, raw: bytes, phrases: list[str]) -> np.ndarray:
    """Mask over the words of some texts: where one of the phrases begins."""
    found = np.zeros(len(words.hash), bool)
    sizes = words.end - words.start + 1
    texts = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if last - first >= PHRASE:
            line = b" ".join(raw[a:b] for a, b in zip(words.start[first:last].tolist(), words.end[first:last].tolist(), strict=True))
            texts.append((first, np.cumsum(sizes[first:last]) - sizes[first:last], f" {line.decode('latin-1')} "))
    for automaton in _automata(phrases):
        for first, begins, line in texts:
            at = [end - size + 1 for end, size in automaton.iter(line)]
            if at:
                found[first + np.searchsorted(begins, at)] = True
    return found


def _located(window: int):
    """Texts, the rows that stand for theirs (doc_order, key) and the bucket's phrases (words) -> (part, check, later, doc_order, key, start, n).

    Windows are compared by two hashes, part and check. The result are candidate windows; later ones are in runs of n starts.
    """

    def run(_, texts: pa.Table, given: pa.Table) -> pa.Table:
        phrases = given.column("words").drop_null().to_pylist()
        first = set(_rows_of(given.filter(pc.is_null(given.column("words")))))
        rows = _rows_of(texts)
        mine = [i for i, row in enumerate(rows) if row in first] if phrases else []
        out = []
        for lo, hi, data, offsets in slices(texts.column("text").take(pa.array(mine, pa.int64())), 2 * BUCKET):
            words = Words(data, offsets)
            _, starts, places = _selected(words, window)
            if not len(starts):
                continue
            found = locate(words, data.tobytes(), phrases)
            starts = starts[found[places]]
            if not len(starts):
                continue
            grams, _ = words.grams(window)
            checks, _ = words.grams(window, word_hashes(data, words.start, words.end, seed=1))
            order, keys = (np.array(x, np.int64) for x in zip(*(rows[i] for i in mine[lo:hi]), strict=True))
            text = np.searchsorted(words.first, starts, "right") - 1
            gram, check, doc, start = grams[starts].view(np.int64), checks[starts].view(np.int64), order[text], starts - words.first[text]
            # of equal windows only the earliest here is compared with others'; the rest are later and dealt anywhere
            by = np.lexsort((start, doc, check, gram))
            head = np.flatnonzero(np.concatenate(([True], (gram[by][1:] != gram[by][:-1]) | (check[by][1:] != check[by][:-1]))))
            head = np.repeat(head, np.diff(np.concatenate((head, [len(gram)]))))
            later = np.empty(len(gram), bool)
            later[by] = (doc[by] != doc[by][head]) | (start[by] != start[by][head])
            # in order of text and start, neighbours that are later make one run
            begins = np.concatenate(([True], ~(later[1:] & later[:-1] & (text[1:] == text[:-1]) & (start[1:] == start[:-1] + 1))))
            at = np.flatnonzero(begins)
            n = np.diff(np.concatenate((at, [len(gram)])))
            gram, check, doc, start, key, later = gram[at], check[at], doc[at], start[at], keys[text[at]], later[at]
            part = np.where(later, mix((gram + doc * 31 + start).view(np.uint64)).view(np.int64), gram)
            out.append(pa.table({"part": pa.array(part), "check": pa.array(check), "later": pa.array(later), "doc_order": pa.array(doc), "key": pa.array(key), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32))}))
        return pa.concat_tables(out) if out else LOCATED.empty_table()

    return run


LOCATED = pa.schema([("part", pa.int64()), ("check", pa.int64()), ("later", pa.bool_()), ("doc_order", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _cut(window: int, inner: list[str], names: list[str]):
    """Texts, and (doc_order, key, start, n) of repeated windows, or start null for rows that are no later copy -> with kept_text, n_words and n_removed."""

    def run(_, texts: pa.Table, given: pa.Table) -> pa.Table:
        runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, start, n in zip(_rows_of(given), given.column("start").to_pylist(), given.column("n").to_pylist(), strict=True):
            own = runs.setdefault(row, [])
            if start is not None:
                own.append((start, n))
        kept, counts, removed = [], [], []
        for text, row in zip(texts.column("text").to_pylist(), _rows_of(texts), strict=True):
            words = (text or "").encode().split()
            n, gone = len(words), 0
            if row not in runs:  # a later copy
                if n >= window:
                    words, gone = [], n
            elif runs[row]:
                edge = np.zeros(n + 1, np.int32)
                at, length = np.array(runs[row]).T
                np.add.at(edge, at, 1)
                np.subtract.at(edge, at + length - 1 + window, 1)
                keep = np.cumsum(edge[:n]) == 0
                words, gone = [w for w, k in zip(words, keep.tolist(), strict=True) if k], n - int(keep.sum())
            kept.append(b" ".join(words).decode())
            counts.append(n)
            removed.append(gone)
        columns = [texts.column(c) for c in inner] + [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        return pa.table(columns, names=[*names, "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the words of repeated windows.

    Returns doc_id, text, the columns in ``keep``, kept_text (kept words joined by one space), n_words, n_removed.
    A null text has no words and kept_text ''. A text under ``window`` words is kept. A null doc_id comes before all
    others. Rows with equal doc_id and text are one document twice and are treated alike; rows with equal doc_id and
    different texts stand at equal places, so neither is earlier than the other, nor is an equal place in both.
    """
    if window < PHRASE:
        raise ValueError(f"window must be at least {PHRASE} words")
    # kept columns go under names of their own, so that none clashes with one used here
    names, inner = ["doc_id", "text", *keep], ["_doc_id", "text", *(f"_keep{i}" for i in range(len(keep)))]
    rows = docs.select(F.col("doc_id").alias("_doc_id"), "text", *(F.col(c).alias(n) for c, n in zip(keep, inner[2:], strict=True)), doc_order().alias("doc_order"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("doc_order", "key"), F.lit(max(1, -(-size // BUCKET)))).alias("bucket")
    light = rows.groupBy("key").agg(F.min("doc_order").alias("doc_order"))

    found = rows.select("text", "key").mapInArrow(tidy(_phrases(window)), "part long, sure boolean, phrase long, key long, n int")
    # copies of a text in several tasks: n of the one that spoke for a whole batch holds, and any other is no evidence against it
    found = found.repartition("part", "sure").groupBy("part", "sure", "phrase", "key").agg(F.max("n").alias("n"))
    recurring = found.withColumn("total", F.sum("n").over(Window.partitionBy("part", "sure"))).where("sure or total >= 2").select("phrase", "key")
    recurring = materialize(recurring.join(light, "key"), "recurring")

    dealt = rows.select("*", bucket).repartition("bucket").groupBy("bucket")
    firsts = light.select(bucket, "doc_order", "key")
    speakers = recurring.groupBy("phrase").agg(F.min(F.struct("key", "doc_order")).alias("by")).select("by.*", "phrase").select(bucket, "doc_order", "key", "phrase")
    spoken = dealt.cogroup(speakers.groupBy("bucket")).applyInArrow(_spoken(window), "phrase long, words string")  # a phrase has one speaker, and equal rows share a bucket
    none = F.lit(None).cast("long")
    given = recurring.join(spoken, "phrase").select(bucket, none.alias("doc_order"), none.alias("key"), "words").distinct()
    given = given.unionByName(firsts.withColumn("words", F.lit(None).cast("string")))
    located = dealt.cogroup(given.groupBy("bucket")).applyInArrow(_located(window), "part long, check long, later boolean, doc_order long, key long, start int, n int")
    at = F.struct("doc_order", "start")
    first = located.withColumn("first", F.min(at).over(Window.partitionBy("part", "check", "later")))
    repeated = first.where(F.col("later") | (at > F.col("first"))).select(bucket, "doc_order", "key", "start", "n")
    # a whole copy of an earlier text: its order is not the least of its key
    given = repeated.unionByName(firsts.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("n")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return dealt.cogroup(given.groupBy("bucket")).applyInArrow(_cut(window, inner, names), f"{types}, kept_text string, n_words long, n_removed long")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract query: windows of 20 words over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
