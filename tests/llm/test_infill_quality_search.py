"""Fill-in-the-middle, quality rules and ranked search against brute force, on awkward tables and on small chunks, slices and blocks."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, fill_in_middle, quality, ranked_search

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = {c: "x" for c in ("n", "form", "h", "item", "check", "terms", "level", "stratum", "_text", "_keep0", "kept", "m", "l")}
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def _texts():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abÉdé9") for _ in range(rng.randint(1, 12))) for _ in range(50)]
    say = lambda n, sep=(" ", "  ", "\n", " \t "): "".join(w for _ in range(n) for w in (rng.choice(vocab), rng.choice(sep)))
    out = [None, "", " ", "\n\n", "x", " x", "x ", "a <P> b", "<M>", "< P >", "  x y", say(1), say(19), say(20), "Z" * 30_000, " " * 9000 + "é" * 9000, say(4000)]
    line = say(12).replace("\n", " ")
    for i in range(40):
        t = say(rng.randint(5, 90))
        if i % 3 == 0:
            t += "\n" + line + "\n" + line + "\n  \n" + line
        if i % 5 == 0:
            t = re.sub(r"(\w+)", r"\1###", t)
        if i % 7 == 0:
            t = t.upper() + "!!! ?"
        out.append(t)
    return out + [out[20], out[20]]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    return [(i * 7, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)] + [(None, texts[16], "en"), (None, None, None), (7, texts[18], "xx"), (1 << 62, "term " * 50, "en"), (-5, "term " * 50, "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).select("*", *(F.lit(v).alias(k) for k, v in CLASH.items())).persist()


def _cut(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, rows):
    out = fill_in_middle.fill_in_middle(docs, keep=("lang", "n"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    names = out.columns
    assert names == ["doc_id", "lang", "n", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = out.withColumn("back", back).collect()
    expected = sorted(((i, lang, "x", *_cut(i, t), t or "") for i, t, lang in rows), key=str)
    assert sorted(map(tuple, found), key=str) == expected
    assert {r[4] for r in found} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("chunk,block", [(1, 1), (2, 3), (5, 2), (4096, 128)])
def test_cuts_of_chunks_of_any_size(rows, chunk, block):
    texts = [t or "" for _, t, _ in rows if len(t or "") < 3000]
    raw = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    chunks = fill_in_middle.Chunks(np.frombuffer(raw, np.uint8), offsets, chunk, block)
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert chunks.n[i] == len(tokens)
        for rank in {0, 1, 2, len(tokens) // 2, len(tokens)} & set(range(len(tokens) + 1)):
            head = "".join(tokens[:rank])
            assert chunks.cut(i, rank) == (offsets[i] + len(head.encode()), len(head))


def test_sentinels_that_cannot_be_told_apart_are_refused(docs):
    for bad in (("<P>", "<P>", "<M>"), ("<<P", "<<S", "<<M"), ("", "b", "c"), ("<PP>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, sentinels=bad)


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    many = lambda these: sum(c in these for c in text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": many("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    return out | {"n_lines": len(lines), "n_marks": many("!?"), "n_upper": many("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words)}


def _levels(f):
    best = quality.LEVELS + 1
    for part, whole, loose, strict in quality.PATH.values():
        for i, c in enumerate(quality.cutoffs(loose, strict, quality.LEVELS)):
            if 1000 * f[part] > c * f[whole]:
                best = min(best, i + 1)
                break
    return best


def _tail(m, x, p):
    return sum(Fraction(math.comb(m, i)) * p**i * (1 - p) ** (m - i) for i in range(x + 1))


@pytest.mark.parametrize("risk,delta", [(0.05, 0.05), (0.4, 0.5), (0.25, 0.9)])
def test_quality_rules(spark, docs, rows, risk, delta):
    rng = random.Random(3)
    labels = [(i, rng.choice((1, 1, 1, 0)), 0) for i, _, _ in rows if rng.random() < 0.9] + [(None, 1, 1), (7, None, 0), (10**9, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good_ids = {i for i, q, _ in labels if q == 1 and i is not None}
    good = {(lang, t or "", _levels(_base(t))) for i, t, lang in rows if i in good_ids and not _base(t)["base_failed"]}
    chosen = {}
    for lang in {g[0] for g in good}:
        levels = [g[2] for g in good if g[0] == lang]
        chosen[lang] = 0
        for at in range(1, quality.LEVELS + 1):
            if _tail(len(levels), sum(x <= at for x in levels), Fraction(str(risk))) > Fraction(str(delta)) / len({g[0] for g in good}):
                break
            chosen[lang] = at
    expected = []
    for i, t, lang in rows:
        f = _base(t)
        expected.append((i, *(f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), not f["base_failed"] and _levels(f) > chosen.get(lang, 0)))
    out = quality.judge(docs, frame, risk=risk, delta=delta)
    found = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    if risk == 0.4:
        assert any(chosen.values()) and any(not r.kept and not r.base_failed for r in found)


def test_quality_rules_stay_in_the_jvm(spark, docs):
    plan = quality.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_binomial_tail(spark):
    cases = [(m, x, p) for m in (0, 1, 7, 200, 5000) for x in {0, 1, 3, m // 60, m // 21, m} if x <= m for p in (0.02, 0.05)]
    for p in (0.02, 0.05):
        some = [(m, x) for m, x, q in cases if q == p]
        found = spark.createDataFrame(some, "m long, x long").select("m", "x", quality.lower_tail(F.col("m"), F.col("x"), p).alias("t")).collect()
        for m, x, t in found:
            assert t == pytest.approx(1.0 if x >= m * p else float(_tail(m, x, Fraction(str(p)))), rel=1e-9)


def test_thresholds_hold_their_risk():
    """The chosen levels lose more than the risk in at most a share delta of repeated draws of labels."""
    rng, failed, trials = np.random.default_rng(5), 0, 400
    # levels of good texts: the share lost up to a level grows along the path and passes the risk at level 5
    lost = np.array([0.005, 0.01, 0.02, 0.045, 0.07, 0.2])
    for _ in range(trials):
        at = np.searchsorted(lost, rng.random(500))
        x = [int((at <= i).sum()) for i in range(6)]
        chosen = 0
        for i in range(6):
            if x[i] >= 500 * 0.05 or float(_tail(500, x[i], Fraction(1, 20))) > 0.05:
                break
            chosen = i + 1
        failed += chosen > 0 and lost[chosen - 1] > 0.05
    assert failed <= 0.05 * trials + 3 * math.sqrt(0.05 * trials)


def _search(rows, items, k=10):
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]
    docs = [(i, Counter(lower(t)), len(lower(t))) for i, t in rows if lower(t)]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(lower(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, tf, n in docs:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, -(1 << 63) if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs", [1 << 20, 30])
def test_ranked_search(spark, docs, rows, monkeypatch, pairs):
    monkeypatch.setattr(ranked_search, "PAIRS", pairs)
    texts = [t for _, t, _ in rows if t]
    items = [(1, texts[15]), (2, texts[16][:200].upper()), (3, None), (4, ""), (5, "nothing here"), (6, "TERM"), (6, "terM x"), (None, texts[30]), (7, texts[40]), (7, texts[40]), (8, "É é   " + "w" * 70)]
    frame = spark.createDataFrame(items, "item_id long, text string").select("*", *(F.lit(v).alias(k) for k, v in CLASH.items()))
    found = ranked_search.search(docs, frame)
    assert sorted(map(tuple, found.collect()), key=str) == _search([(i, t) for i, t, _ in rows], items)


def test_search_slices_of_any_size(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += texts[:5] * 3
    items = [" ".join(rng.sample(words, 9)) for _ in range(25)]
    asked = [b.to_pandas() for b in ranked_search._asked([pa.record_batch({"item": pa.array(range(25)), "text": pa.array(items)})])]
    table = asked[0].drop_duplicates()
    term = table[["h", "check", "size"]].drop_duplicates()
    h = np.sort(term["h"].to_numpy().view(np.uint64))
    order = np.argsort(term["h"].to_numpy().view(np.uint64))
    place = np.searchsorted(h, table["h"].to_numpy().view(np.uint64))
    by = np.argsort(place, kind="stable")
    first = np.searchsorted(place[by], np.arange(len(h) + 1))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    posts = list(ranked_search._postings(h, term["check"].to_numpy().view(np.uint64)[order], term["size"].to_numpy()[order])([batch]))
    weight = np.arange(1, len(h) + 1) * 100
    weight[3] = 0
    total = sum(len(t.split()) for t in texts)
    results = []
    for entries, packed in ((1 << 21, 1 << 16), (1, 1), (50, 200), (1 << 21, 1 << 22)):
        monkeypatch.setattr(ranked_search, "ENTRIES", entries)
        monkeypatch.setattr(ranked_search, "PACKED", packed)
        out = list(ranked_search._scored(weight, first, table["item"].to_numpy()[by], 25, len(texts), total, 10)(posts))
        results.append(sorted(zip(*(c.to_pylist() for c in out[0].columns), strict=True)))
    assert all(r == results[0] for r in results) and len(results[0]) == 250


def test_radix_order():
    rng = np.random.default_rng(2)
    for top in (1, 1 << 15, 1 << 17, 1 << 40, (1 << 62) + 5):
        keys = rng.integers(0, top, 500)
        assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_word_hashes():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abAB é9") for _ in range(rng.choice((1, 7, 8, 9, 16, 17, 63, 64, 65, 300)))).replace(" ", "") or "z" for _ in range(400)})
    raw = b" ".join(w.encode() for w in words)
    got = common.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(got.start, got.end, strict=True)] == words and len(set(got.hash.tolist())) == len(words)
    alone = [common.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hash[0] for w in words]
    assert (got.hash == alone).all()
    lowered = common.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash
    low = b" ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in words)
    assert (lowered == common.Words(np.frombuffer(low, np.uint8), np.array([0, len(low)])).hash).all()
    assert (common.word_hashes(np.frombuffer(raw, np.uint8), got.start, got.end, seed=1) != got.hash).all()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_quality_rules", "op13_ranked_search"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from strandlake.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)
