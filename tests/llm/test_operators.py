"""Each operator against a brute-force version on rows with nulls, empty and long texts, copies, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import fingerprints, jaccard_join, packing, pii, sentencepiece_codec, sharding, substring_dedup, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "key long, doc_order long, start string, part int, n long, value string, ids string, at string"


def _texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, line = say(70), say(25)
    out = [None, "", " \n\t", "x", "one two three", " ".join(line), "same " * 300]
    for i in range(40):
        words = say(rng.randint(5, 120))
        if i % 4 == 0:
            words[3:3] = passage[: 20 + i]
        if i % 5 == 0:
            words += line + ["\n"] + line
        out.append(" ".join(words) + ("\n" if i % 3 else "  \n ") + " ".join(say(4)))
    base = say(200)
    for i in range(12):  # near copies
        words = list(base)
        words[(i * 17) % 200] = "changed"
        out.append(" ".join(words).capitalize())
    out += [out[8], out[8], out[9], " ".join(say(30_000))]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = [x.split()[0] for x in EXTRA.split(", ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit(None).cast(x.split()[1]).alias(n) for n, x in zip(names, EXTRA.split(", "), strict=True))).persist()


def _clean(text):
    return text or ""


def test_shards(docs, rows):
    out = sharding.shard(docs, 4).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in out) == [d for d, _ in rows]
    size = [0] * 4
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in out:
        raw = _clean(texts[r.doc_id]).encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r["size"]
    largest = max(r["size"] for r in out)
    assert max(size) - min(size) <= 2 * largest


def test_shards_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([(None, "abc" * 50)] * 400, "doc_id long, text string")
    counts = sorted(r["count"] for r in sharding.shard(same, 8).groupBy("shard").count().collect())
    assert len(counts) == 8 and counts[-1] - counts[0] <= 1
    assert sharding.shard(same.limit(0), 8).count() == 0


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(docs, path, capacity=256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, text in rows:
        ids = tokenizer.encode(_clean(text), add_special_tokens=False).ids + [0]
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(r.length == 256 for r in own[1:]) and (len(own) == 1 or len(ids) > 256)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in own)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s[:-1]])) and sum(r.length for r in s) <= 256
    assert len(sequences) <= -(-sum(r.length for r in out) // 256) * 1.08 + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_plan_holds_each_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(5):
        histogram = np.bincount(rng.integers(1, 129, 3000), minlength=129)
        used, n = np.zeros(129, int), 0
        for repeats, lengths in packing.plan(histogram, 128, grain=8):
            assert sum(lengths) <= 128
            np.add.at(used, list(lengths), repeats)
            n += repeats
        assert (used == histogram).all()
        assert n <= 1.02 * (histogram * np.arange(129)).sum() / 128 + 2


def test_fingerprints(docs, rows):
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    down = sorted(rows, reverse=True)
    size = lambda p: min(len(p) + 1, (1 << 20) - 1)
    seen = {}
    for i, (d, text) in enumerate(down):
        text, following = _clean(text), _clean(down[(i + 1) % len(down)][1])
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = out[d]
        assert r.edited_text == edited and r.n_chars == len(text)
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = set(text.split("\n")), set(other.split("\n"))
            assert near == pytest.approx(1 - sum(map(size, a ^ b)) / (sum(map(size, a)) + sum(map(size, b))))
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_fingerprint_retries_larger(spark):
    a, b = "\n".join(f"line {i}" for i in range(300)), "\n".join(f"row {i}" for i in range(250))
    out = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert out[1].near_next == 0.0 and 0.3 < out[1].near_edited < 0.7


def test_fingerprint_beyond_the_largest_sketch(spark):
    a = [f"line {i}" for i in range(40_000)]
    b = a[:20_000] + [f"row {i}" for i in range(20_000, 40_000)]
    keys = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").select(*(fingerprints.paragraph_keys(F.col(c)).alias(c) for c in "ab"))
    keys = keys.select("*", *(fingerprints.sketch(F.col(c)).alias(f"cells_{c}") for c in "ab"))
    near = keys.select(fingerprints.likeness(*(F.col(c) for c in ("a", "cells_a", "b", "cells_b")))).first()[0]
    size = lambda lines: sum(len(x) + 1 for x in lines)
    assert near == pytest.approx(1 - size(set(a) ^ set(b)) / (size(a) + size(b)))


def test_fingerprint_when_no_size_peels(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SIZES", 2)
    a = "\n".join(f"line {i}" for i in range(400))
    out = fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, a[: len(a) // 2])], "doc_id long, text string"))
    assert 0.6 < {r.doc_id: r.near_next for r in out.collect()}[1] < 0.7


def test_substring_dedup(docs, rows):
    first, expected = {}, {}
    for d, text in rows:
        words = WORD.findall(_clean(text))
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if first.setdefault(tuple(words[s : s + 20]), (d, s)) != (d, s):
                gone[s : s + 20] = [True] * 20
        expected[d] = (" ".join(w for w, g in zip(words, gone, strict=True) if not g), len(words), sum(gone))
    out = {r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, keep=("n", "start")).collect()}
    assert out == expected and sum(v[2] for v in expected.values()) > 500
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_copy_in_another_task(spark):
    rng = random.Random(11)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    tasks, first, d = [[], []], [], 0
    for i in range(40):  # a passage in two texts of one task, and a copy of one of them in the other task; each task comes first once
        passage = say(30)
        one, two = (" ".join(say(20) + passage + say(20)) for _ in range(2))
        tasks[i % 2] += [(d, one), (d + 1, two)]
        tasks[1 - i % 2].append((d + 2, one))
        first.append(d)
        d += 3
    rows = spark.createDataFrame(spark.sparkContext.parallelize(tasks, 2).flatMap(list), "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(rows).collect()}
    assert out == {d + j: n for d in first for j, n in enumerate((0, 30, 70))}


@pytest.mark.parametrize("size,threshold,hot", [(4, 85, 5000), (5, 80, 3)])
def test_jaccard_components(docs, rows, size, threshold, hot):
    sets = {}
    for d, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), _clean(text)))
        sets[d] = set() if not words else {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, size, threshold, hot=hot, bucket_rows=8).collect()}
    assert out == {d: (len(sets[d]), find(d)) for d in sets}


def test_count_tree_loses_no_partner():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.04 * (i % 5)], rng.integers(0, 1 << 60, 5 * (i % 7)).astype(np.uint64)))) for i in range(80)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    tree = jaccard_join.CountTree(np.concatenate(sets), first)
    for i, a in enumerate(sets):
        near = set(tree.near(i, 85).tolist())
        assert {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))} <= near


def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 200 + "é</p>\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/", "short"), (2, None, "short"), (3, "http://b/", long), (4, "http://c/", long), (5, "http://d/", None), (6, "http://e\n/", ""), (9, "http://b/", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), per_file=2)
    captures = {r.page_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert len(captures) == len(pages)
    for page, _, html in pages:
        raw = _clean(html).encode()
        r = captures[page]
        assert r.response.payload_bytes == len(raw) and r.response.payload_digest == hashlib.sha256(raw).hexdigest()
        assert r.response.record_type == ("revisit" if page in (4, 9) else "response") and r.request.record_id and r.metadata.record_id
        assert (r.response.payload is None) == (page in (4, 9)) and (r.response.payload is None or bytes(r.response.payload) == raw)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=16) * rng.choice([0.01, 0.1, 1.0])).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(30)]  # ties
    vectors += [(3000, None), (3001, [1.0, None] * 8), (3002, [float("nan")] * 16), (3003, [0.0] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = topk.quantise(df)
    out = sorted(map(tuple, topk.top_k(rows.where("vec_id % 50 = 0"), rows).collect()))
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vectors if v is not None and i not in (3001, 3002)}
    expected = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert out == expected


def test_pii(spark):
    texts = ["mail me: a.b@x-y.co.uk, c@d@e.fr", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "call +1 (523) 555-1055 é +12", None, "", "@" * 500 + "1" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert out[0].base_spans == "email:9:22,email:26:32"
    assert (out[1].n_ip, out[2].n_card, out[3].n_phone) == (2, 1, 1)
    assert "[PHONE]" in out[3].redacted_text and out[4].redacted_text is None and out[5].spans == ""
    assert all(set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(","))) for r in out.values())
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_reliabilities_find_the_better_labeler():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    vote = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.6)], 1)
    patterns, n = np.unique(vote, axis=0, return_counts=True)
    p, table = pii.reliabilities(np.zeros(len(patterns), int), patterns, n.astype(float))
    assert table[0, 1, 0, 2] > table[0, 1, 2, 2]
    chance = {tuple(v): x for v, x in zip(patterns, p, strict=True)}
    assert np.mean([(chance[tuple(v)] > 0.5) == t for v, t in zip(vote, truth, strict=True)]) > 0.93


def test_sentencepiece(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()
    texts = dict(rows)
    for r in out:
        assert r.ids == sp.encode(_clean(texts[r.doc_id])) and r.decoded == _clean(texts[r.doc_id])
    odd = ["Hello  world", " a\n b", "ＡＢ😀", "a   ", "    x   y" + " " * 40]
    assert [x.tolist() for x in sentencepiece_codec.codec(path).encode(odd)] == sp.encode(odd)


def test_viterbi_equals_brute_force():
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"]
    scores = [-3.1, -2.9, -3.3, -4.0, -4.2, -5.7, -4.9, -5.5, -4.4]
    vocab = sentencepiece_codec.Pieces(pieces, scores, ["normal"] * len(pieces))
    rng = random.Random(3)
    table = dict(zip(pieces, scores, strict=True))

    def best(s):
        return max([(table[s[:i]] + best(s[i:])[0], [s[:i], *best(s[i:])[1]]) for i in range(1, len(s) + 1) if s[:i] in table], default=(0.0, []) if not s else (-1e9, []))

    words = ["".join(rng.choice("abc") for _ in range(7)) for _ in range(60)]
    mask = sentencepiece_codec.viterbi(np.array([[ord(c) for c in w] for w in words]), vocab)
    for w, m in zip(words, mask, strict=True):
        cuts = [0, *(np.flatnonzero(m) + 1)]
        assert sum(table[w[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best(w)[0])


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    vocab = [f"w{i}x" .replace("0", "o").replace("1", "l") for i in range(300)]
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["vile", "nasty", "horrid", "foul"]
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 1202):
        words, toxic = [rng.choice(vocab) for _ in range(60)], i % 6 == 0
        for _ in range(rng.randint(2, 8) if toxic else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:800], "doc_id long, toxic int"))
    out = {r.doc_id: r.severity for r in toxicity.score(docs, model).collect()}
    assert len(out) == len(rows) and out[0] == out[1] < toxicity.REJECT
    held = [(out[i] >= toxicity.REJECT, bool(t)) for i, t in labels[800:]]
    assert all(found == true for found, true in held)
    assert model.thresholds[0] < model.thresholds[1]
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.severity < 1e-6 for r in toxicity.score(docs, none).collect())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = stage(spark, docs, sf).persist()
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in seen[1:])
    kept = {r.doc_id for r in seen[-1].collect()}
    assert {r.doc_id for r in docs.collect()} == kept
    assert 0.6 * seen[0].count() < len(kept) < seen[0].count()


def test_one_of_each_class_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    say = lambda: [f"w{rng.randrange(10_000)}" for _ in range(80)]
    near = lambda words: " ".join([*words[:-1], f"n{rng.randrange(10_000)}"])
    a, b, c, d = say(), say(), say(), say()
    texts = [
        (1, " ".join(a)), (1, " ".join(a)), (1, " ".join(a)),  # repeated rows
        (2, " ".join(b)), (2, near(b)), (3, near(b)),  # near copies under one doc_id
        (None, " ".join(c)), (None, near(c)), (None, " ".join(c)), (9, near(c)), (None, " ".join(say())),  # and under none
        (4, " ".join(d)), (4, " ".join(say())),  # strangers under one doc_id
        (5, ""), (6, ""), (7, None),
    ]
    rows = [(i, t, "en", f"s{j}", len(t or "")) for j, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.one_of_each_class(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "4", "4", "5", "6", "7", "None", "None"]
    assert {r.source for r in out} >= {"s0", "s10", "s11", "s12", "s13", "s14", "s15"}


def _thue_morse(n=1024):
    """A word of a and b and its complement, which sums of letters by powers of an odd number modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    one, two = _thue_morse()
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85).collect()) == [(1, 1), (2, 2)]
    same = [f"w{i}" for i in range(20)]
    texts = [" ".join([*same, *(f"x{i}" for i in range(10)), w, *(f"y{i}" for i in range(9))]) for w in (one, two)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()) == [(0, 0), (1, 30)]


def test_pipeline_keeps_words_that_a_polynomial_cannot_tell_apart(spark):
    import corpus_pipeline

    one, two = _thue_morse()
    df = spark.createDataFrame([(1, one, "en", "s", 1024), (2, two, "en", "s", 1024)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_class(spark, df, "").collect()) == [1, 2]


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_top_k_of_null_large_and_repeated_ids_equals_sql(spark, tmp_path, monkeypatch, block):
    import duckdb

    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rng = np.random.default_rng(9)
    big = 1 << 60
    ids = [None, None, big + 1, big + 3, big + 16, big + 16, 100, 100, 100, 200, *range(1, 40), *range(1000, 1400, 50)]
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in ids] + [(300, [1.0, 2.0]), (301, [2.0, 2.0]), (400, []), (500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(topk.OP7_SQL).fetchall()
    out = topk.op7_exact_topk(spark, str(tmp_path))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert sum(r[0] == 100 and r[1] == 1 for r in expected) == 3 and {r[2] for r in expected} >= {big + 1, big + 3}


def test_long_units_are_encoded_like_short_ones(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load(path))
    rng = random.Random(8)
    units = ["▁" + "".join(rng.choice("etaoinshrdluéß日#") for _ in range(n)) for n in (2, 3, 30, 200, 511, 512)] + ["a" * 300, "▁" * 70, "日" * 40, "thethethe" * 40]
    short = sentencepiece_codec.encode_kinds(units, codec.pieces)
    monkeypatch.setattr(sentencepiece_codec, "LONG", 1)
    long = sentencepiece_codec.encode_kinds(units, codec.pieces)
    for a, b in zip(short, long, strict=True):
        assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))
    monkeypatch.undo()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("".join(rng.choice("etaoinshrdlu") for _ in range(64_000)), "x" * 20_000, "ab" * 5000 + "é日" * 300):
        best, own = codec.encode_both([text])
        assert own[0].tolist() == library.encode(text)
        assert codec.decode(best[0]) == text


def test_a_million_letters_without_space():
    import time

    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    text = "".join(random.Random(1).choices("etaoinshrdlucmfw", k=1_000_000))
    began = time.time()
    best, own = codec.encode_both([text])
    assert time.time() - began < 120 and codec.decode(own[0]) == text and codec.decode(best[0]) == text
