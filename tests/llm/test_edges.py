"""Each query itself on awkward tables, base patterns against plain regular expressions, and quality on held-out cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from strandlake.llm import fingerprints, packing, pii, queries, sentencepiece_codec, substring_dedup, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that no query knows, with names that operators use inside
CLASH = {c: "x" for c in ("key", "doc_order", "bucket", "start", "n", "h", "part", "value", "ids", "severity", "kept_text", "_node", "range", "phrases", "_keep0")}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _save(spark, path, rows, schema, **extra):
    df = spark.createDataFrame(rows, schema).repartition(2)
    df.select("*", *(F.lit(v).alias(k) for k, v in extra.items() if k not in df.columns)).write.parquet(path)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, repeated rows, ties, empty and long texts, repeated and null ids, ids far apart."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("ab cde fghi é jkl mno pq".split()) + str(rng.randrange(40)) for _ in range(n))
    one, two = say(60), say(60)
    texts = [None, "", " ", "x", one, one, two, say(2000), "mail a@b.cc +1 (523) 555-1055", "\n" * 2100, one + " tail"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (6, one, None, None, None), (None, two, None, None, None), (None, two, None, None, None), (None, None, None, None, None), (1 << 62, say(30), "en", "s", 1), (-(1 << 62), say(30), "en", "s", 1)]
    d = str(tmp_path_factory.mktemp("awkward"))
    _save(spark, f"{d}/documents.parquet", rows, DOCS, **CLASH)
    _save(spark, f"{d}/labels.parquet", [(i, None, i % 2) for i in range(8)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int", **CLASH)
    html = "<p>" + "y" * 200
    pages = [(1, "http://a", html), (1, "http://a", html), (2, None, html), (3, "u", None), (None, None, html), (4, "u", "short"), (5, "u", "short"), (2, "other", "z" * 150)]
    _save(spark, f"{d}/pages.parquet", pages, "page_id long, url string, html string", **CLASH)
    vectors = [(i * 50, [1.0, float(i % 3), -2.0]) for i in range(12)] + [(7, None), (8, []), (9, [float("nan"), 1.0, 1.0]), (100, [1.0, 1.0, -2.0]), (11, [None, 1.0, 1.0])]
    _save(spark, f"{d}/embeddings.parquet", [*vectors, vectors[1]], "vec_id long, embedding array<double>", **CLASH)
    items = [(1, one), (1, "pq1 pq2"), (None, two), (2, None), (3, ""), (4, two), (4, two), (5, "nowhere found")]
    _save(spark, f"{d}/benchmark.parquet", items, "item_id long, text string", **CLASH)
    return d, rows, pages


@pytest.fixture(scope="module")
def empty(spark, awkward, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{awkward[0]}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_on_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_empty_and_awkward_tables(spark, empty, awkward):
    assert corpus_pipeline.run(spark, empty).collect() == []
    d, rows, _ = awkward
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d).persist()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before.count()
        if name == "jaccard_join":  # one of each class of equal or near texts; texts without words stay
            assert sorted(r.text for r in docs.where("text is not null").collect() if WORD.search(r.text)) == sorted({t for i, t, *_ in rows if t and WORD.search(t) and not t.endswith(" tail")})
    assert docs.count() >= before.count()


def _texts(rows):
    return [(d, t or "") for d, t, *_ in rows]


def test_sharding_query(spark, awkward):
    d, rows, _ = awkward
    out = queries.QUERIES["op1_sharding"](spark, d).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in _texts(rows))
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and all(0 <= r.shard < 8 for r in out)


def test_packing_query(spark, awkward):
    d, rows, _ = awkward
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = queries.QUERIES["op2_best_fit_packing"](spark, d).collect()
    ids = [(str(i), tokenizer.encode(t, add_special_tokens=False).ids + [0]) for i, t in _texts(rows)]
    expected = []
    for i, x in ids:
        edges = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    for s in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 2048


def test_very_long_white_space_is_encoded(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = " " * 1_000_000 + "a"
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode([text, "b"])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprint_query(spark, awkward):
    d, rows, _ = awkward
    out = queries.QUERIES["op3_fingerprints"](spark, d).collect()
    distinct = [(i, t) for i, t in _texts(rows) if i is not None and sum(j == i for j, *_ in rows) == 1]
    assert len(out) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    prints = {}
    for r in out:
        if (r.doc_id, r.n_chars) in {(i, len(t)) for i, t in distinct}:
            prints[r.doc_id] = r
    down = sorted({i for i, *_ in rows if i is not None}, reverse=True)
    texts = dict(distinct)
    for i, following in zip(down, down[1:], strict=False):  # where own and next text are beyond doubt
        if i in texts and following in texts:
            t, half = texts[i], len(texts[i]) // 2
            assert prints[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + texts[following][:half]).encode()).hexdigest()


def test_fingerprints_of_many_lines_and_of_long_lines(spark):
    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    many = [line() for _ in range(5000)]
    other = many[:3500] + [line() for _ in range(1500)]
    prose = " ".join("".join(rng.choice("aeioubcdlmt") for _ in range(5)) + "." * (i % 9 == 0) for i in range(400))
    texts = {4: "\n".join(many), 3: "\n".join(other), 2: prose, 1: prose[: len(prose) // 2] + "X" + prose[len(prose) // 2 :]}
    out = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), cut=True).collect()}
    a, b = set(many), set(other)
    assert out[4].near_next == pytest.approx(1 - sum(len(x) + 1 for x in a ^ b) / (sum(len(x) + 1 for x in a) + sum(len(x) + 1 for x in b)))
    assert out[2].near_next > 0.8 and 0.3 < out[2].near_edited < 0.75


def test_next_document_of_hot_ids_and_of_none(spark):
    ids = [None] * 700 + [5] * 900 + list(range(10, 900)) + [1 << 62, -(1 << 62)]
    rows = [(d, f"t{i}") for i, d in enumerate(ids)]
    out = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    after = {r.text: r.next_text for r in out}
    assert len(after) == len(rows) and len(set(after.values())) == len(rows)
    known, at, order = dict((t, d) for d, t in rows), "t" + str(ids.index(1 << 62)), []
    for _ in rows:
        order.append(known[at])
        at = after[at]
    assert at == "t" + str(ids.index(1 << 62)) and order == sorted(ids, key=lambda d: (d is None, -(d or 0)))


def _kept(rows):
    """Per row: words, removed and kept text; rows of equal doc_id and text are one document, a null doc_id comes first."""
    order = {}
    for d, t in {(d, t) for d, t in rows}:
        order.setdefault(d is not None and d or -(1 << 63) if d is None else d, []).append(t)
    first = {}
    for d in sorted(order):
        for t in order[d]:
            words = WORD.findall(t)
            for s in range(len(words) - 19):
                first.setdefault(tuple(words[s : s + 20]), (d, s))
    out = []
    for d, t in rows:
        d = -(1 << 63) if d is None else d
        words = WORD.findall(t)
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if first[tuple(words[s : s + 20])] != (d, s):
                gone[s : s + 20] = [True] * 20
        out.append((len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def test_substring_query(spark, awkward):
    d, rows, _ = awkward
    out = queries.QUERIES["op4_substring_dedup"](spark, d).collect()
    texts = [(i, t) for i, t in _texts(rows)]
    assert sorted(("" if r.doc_id is None else str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(("" if i is None else str(i), *x) for (i, _), x in zip(texts, _kept(texts), strict=True))


def test_automata_decide_what_is_repeated(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = say(40)
    docs = spark.createDataFrame([(i, " ".join(say(30) + passage + say(30))) for i in range(4)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 40, 40, 40]
    # the automata are given the phrases' words and find them in any text, also in small shards
    words = substring_dedup.Words(np.frombuffer(b"a b c d e f g h i j", np.uint8), np.array([0, 19]))
    raw = b"a b c d e f g h i j"
    for shard in (1, 10):
        monkeypatch.setattr(substring_dedup, "SHARD", shard)
        assert np.flatnonzero(substring_dedup.locate(words, raw, ["b c d e f g h i", "c d e f g h i j", "x b c d e f g h"])).tolist() == [1, 2]
    assert not substring_dedup.locate(words, raw, []).any()


def test_jaccard_query(spark, awkward):
    d, rows, _ = awkward
    out = queries.QUERIES["op5_ngram_jaccard_join"](spark, d).collect()
    assert len(out) == len(rows)
    shingles = lambda t: set() if not (w := WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) else {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
    assert sorted((str(r.doc_id), r.n_shingles) for r in out) == sorted((str(i), len(shingles(t))) for i, t in _texts(rows))
    nodes = sorted({i for i, *_ in rows}, key=lambda i: (i is not None, i or 0))
    sets = {i: [shingles(t) for j, t in _texts(rows) if j == i and shingles(t)] for i in nodes}
    parent = {i: i for i in nodes}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for n, a in enumerate(nodes):
        for b in nodes[n + 1 :]:
            if any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)), key=nodes.index)
                parent[y] = x
    for r in out:
        if sets[r.doc_id] and r.n_shingles:
            assert r.component_id == find(r.doc_id)


def test_warc_query(spark, awkward):
    d, _, pages = awkward
    out = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.QUERIES["op6_warc"](spark, d).collect())
    expected = []
    for page, _, html in pages:
        raw = (html or "").encode()
        least = min((p for p, _, h in pages if h == html and p is not None and len(raw) >= 100), default=None)
        again = page is not None and least is not None and page != least
        expected.append((str(page), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    assert out == sorted(expected)


def test_warc_files_are_gzip_members_that_name_real_records(spark, tmp_path):
    import gzip


    big = "é" * (9 << 20)  # over 16 MiB
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "v", "z")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    headers = []
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        whole = gzip.decompress(raw)  # any reader of gzip takes the members one by one
        assert whole.count(b"WARC/1.1\r\n") == sum(1 for _ in warc.parse_records(raw))
        headers += [h for h, _ in warc.parse_records(raw)]
    ids = {h["warc-record-id"]: h for h in headers}
    assert len(ids) == 9 and [ids[h["warc-refers-to"]]["warc-type"] for h in headers if h["warc-type"] == "revisit"] == ["response"]
    assert {h["warc-concurrent-to"] for h in headers if h["warc-type"] in ("request", "metadata")} == {h["warc-record-id"] for h in headers if h["warc-type"] in ("response", "revisit")}


def test_top_k_query(spark, awkward):
    d, *_ = awkward
    out = queries.QUERIES["op7_exact_topk"](spark, d).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    for q, v in {(i, tuple(v)) for i, v in whole if i % 100 == 0 and sum(j == i for j, _ in whole) == 1}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:10]
        assert sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_beyond_64_bits(spark):
    rows = [(i, [1e12 * (i % 7 - 3), 1e12, -5.0]) for i in range(60)] + [(100, [1e300, -1e300, 0.0]), (101, [0.0] * 3)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = sorted(map(tuple, topk.top_k(vectors.where("vec_id % 50 = 0"), vectors).collect()))
    whole = {r.vec_id: r.v for r in vectors.collect()}
    expected = []
    for q in (0, 50, 100):
        score = lambda i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[i], strict=True))))  # noqa: B023, E731
        best = sorted((-score(i), i) for i in whole if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert out == sorted(expected)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    return sorted((m.start(), n, m.end()) for n, (kind, pattern) in enumerate(PATTERNS.items()) for m in re.finditer(pattern, text) if fits[kind](m[0]))


def test_base_spans_equal_the_plain_patterns(spark, awkward):
    rng = random.Random(12)
    parts = ["a@b.c", "x..y@", "@", ".", "1.2.3.4", "255.256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (523) 555-1055", "+", "-", " ", "é", "9", "00", "12345678", "٣", "(", ")", "a", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    assert all(pii.base_spans(t) == _plain_spans(t) for t in texts)
    assert sum(map(len, map(_plain_spans, texts))) > 3000
    d, rows, _ = awkward
    out = queries.QUERIES["op8_pii"](spark, d).collect()
    expected = []
    for i, t in _texts(rows):
        spans = _plain_spans(t)
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((str(i), *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == sorted(expected)


def _held_out(seed, n):
    """Texts with base spans, looser personal data and decoys; the places of the looser data."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choice("ana bolo casa dime era foto".split()) for _ in range(12)), []
        kind = rng.randrange(7)
        if kind == 0:
            text += f" +1 ({number(3)}) {number(3)}-{number(4)} end"
        elif kind == 1:
            text += f" a.{number(2)}@mail.com end"
        elif kind in (2, 3):  # a phone without its country, a key
            before, data = (" call ", f"({number(3)}) {number(3)}-{number(4)}") if kind == 2 else (' secret = "', "".join(rng.choice("0123456789abcdef") for _ in range(40)))
            spans.append((len(text) + len(before), len(text) + len(before) + len(data)))
            text += before + data + ' " end'
        elif kind == 4:
            text += f" order {number(9)} end"
        elif kind == 5:
            text += f" id {number(16)}z{number(3)} end"
        else:
            text += f" version {number(1)}.{number(8)} end"
        out.append((text, spans))
    return out


def test_what_the_method_adds_on_held_out_texts():
    tallies = {}
    for text, _ in _held_out(1, 4000):
        base = pii.base_spans(text)
        for known, spans in ((True, base), (False, pii.loose_spans(text, base))):
            for a, k, b in spans:
                key = (k, known, pii.votes(text, a, k, b))
                tallies[key] = tallies.get(key, 0) + 1
    weights = pii.weights_of([(*key, n) for key, n in tallies.items()])
    right = found = there = 0
    for text, spans in _held_out(2, 3000):
        base = pii.base_spans(text)
        there += len(spans)
        for a, k, b in pii.loose_spans(text, base):
            if pii.features(np.array([k]), np.array([pii.votes(text, a, k, b)]))[0] @ weights > 0:
                found += 1
                right += (a, b) in spans
    assert right / found >= 0.95 and right / there >= 0.9


def test_sentencepiece_query(spark, awkward):
    import sentencepiece

    d, rows, _ = awkward
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = queries.QUERIES["op9_sentencepiece"](spark, d).collect()
    expected = [(str(i), len(x := sp.encode(t)), zlib.crc32(np.array(x, "<i4").tobytes()), hashlib.sha256(t.encode()).hexdigest()) for i, t in _texts(rows)]
    assert sorted((str(r.doc_id), r.n_ids, r.ids_crc32, r.decoded_sha256) for r in out) == sorted(expected)


def test_viterbi_equals_a_library_on_the_models_own_scores():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    pieces = codec.pieces
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    vocabulary = [("<unk>", 0.0)] + [(sp.id_to_piece(i), score.get(i, -1e6)) for i in range(1, sp.get_piece_size())]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    rng = random.Random(9)
    units = sorted({sentencepiece_codec.SPACE + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 18))) for _ in range(3000)})
    for unit, ids in zip(units, sentencepiece_codec.encode_units(units, pieces), strict=True):
        assert sum(score[i] for i in ids.tolist()) == sum(score[i] for i in library.encode(unit).ids)


def test_toxicity_query(spark, awkward):
    d, rows, _ = awkward
    out = queries.QUERIES["op10_toxicity"](spark, d).collect()
    assert len(out) == len(rows) and all(0 <= r.severity <= 2 and r.grade == round(r.severity) and r.rejected == (r.severity >= toxicity.REJECT) for r in out)


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    import os

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(i, f"http://a/{i}", noise(rng.choice((10, 500, 3000, 20_000)))) for i in range(300)] + [(1000, "u", noise(150_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for most in (40_000, 400_000):
        path = str(tmp_path / f"a{most}")
        warc.write_archives(pages, path, file_bytes=most)
        sizes = sorted(os.path.getsize(f"{path}/{n}") for n in os.listdir(path) if n.startswith("part"))
        assert sum(s > most for s in sizes) <= 1 and sizes[-1] < max(most, 160_000) and len(sizes) > 2
        found = warc.read_records(spark, path).where("record_type = 'response'").select("target_uri", F.decode("payload", "utf-8")).collect()
        assert sorted(map(tuple, found)) == sorted((u, h) for _, u, h in rows)


def test_weight_of_a_very_long_paragraph(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghij", k=2_500_000))
    df = spark.createDataFrame([(1, long + "\nx"), (2, long)], "doc_id long, text string")
    keys = {r.doc_id: r.k for r in df.select("doc_id", fingerprints.paragraph_keys(F.col("text")).alias("k")).collect()}
    weight = lambda ks: sum(k & ((1 << fingerprints.LENGTH_BITS) - 1) for k in ks)
    assert (len(keys[2]), weight(keys[2])) == (3, 2_500_003) and weight(keys[1]) == 2_500_005 and set(keys[2]) <= set(keys[1])
