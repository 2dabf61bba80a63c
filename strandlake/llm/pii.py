"""Personal data by weak supervision.

Spans come from four base patterns (always kept) and from looser ones. Labelers vote on each span: validity, gazetteers,
context words, boundaries and grouping; none is told whether a base pattern found the span. Votes are counted by pattern
over all documents; expectation maximisation on those counts, with base spans as known cases, estimates each labeler's
reliability and gives every pattern a chance of being personal data. A logistic classifier trained on the counts and
chances decides about the looser spans.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: kinds with a base pattern, and all kinds
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][0-9 ()./-]*")
_LOOSE_MAIL = re.compile(r"@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
_TURN = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{16,}")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# gazetteers (fixed values): mail domains' last labels, calling codes, first digits of card numbers, beginnings of access keys
LAST_LABELS = frozenset("com org net edu gov info io de fr es uk it eu us".split())
CALLING_CODES = ("1", "7", "33", "34", "39", "44", "49", "52", "55", "81", "86", "91")
CARD_FIRST = ("34", "37", "4", "51", "52", "53", "54", "55", "6")
KEY_FIRST = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_", "pk_", "xox", "AIza", "eyJ")
CONTEXT = {
    "email": "mail e-mail contact write correo courriel @".split(),
    "ip": "ip host server address addr".split(),
    "card": "card visa mastercard credit carte tarjeta karte".split(),
    "phone": "phone tel call fax mobile telefon".split(),
    "secret": "token secret key password passwd pwd auth bearer credential".split(),
}
AGAINST = "id order isbn version v. no. # page ref".split()
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _mails(text: str, domain: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping local parts with a domain; each '@' looks back as far as the last span's end."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = domain.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns, sorted."""
    out = [(a, 0, b) for a, b in _mails(text, _DOMAIN)] if "@" in text else []
    if _NUMBER.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _turns(s: str) -> int:
    """How often a string changes between digits and letters."""
    return len(_TURN.findall(s))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of looser spans that overlap no base span: mails, numbers, and strings of digits and letters that may be keys."""
    found = [(a, 0, b) for a, b in _mails(text, _LOOSE_MAIL)] if "@" in text else []
    found += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text) if _turns(m[0]) > 1]
    for m in _NUMBER.finditer(text):
        s = m[0].rstrip(" ()./-")
        start, end = m.start(), m.start() + len(s)
        n = sum("0" <= c <= "9" for c in s)
        if n < 7:
            continue
        if start and text[start - 1] == "(":
            start -= 1
        if start and text[start - 1] == "+":
            start -= 1
        found.append((start, 1 if s.count(".") == 3 and len(s) <= 15 and all(s.split(".")) else 2 if n > 12 else 3, end))
    out, i = [], 0
    taken = sorted((a, b) for a, _, b in base)
    for a, k, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in taken[i : i + 4]):
            out.append((a, k, b))
    return out


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Votes 1 (yes), -1 (no) or 0 (none) of the five labelers, then the features: digits in steps, plus, parentheses."""
    s = text[start:end]
    d = _digits(s)
    name = KINDS[kind]
    if name == "email":
        last = s.rpartition(".")[2].lower()
        valid, known, grouped = (1 if last.isalpha() and len(last) > 1 and "@" not in last else -1), (1 if last in LAST_LABELS else -1), (-1 if ".." in s else 1)
    elif name == "ip":
        parts = [p for p in s.split(".") if p.isascii() and p.isdigit()]
        fine = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
        valid, known, grouped = (1 if fine else -1), (-1 if d[:1] == "0" else 1), (-1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1)
    elif name == "card":
        valid = 1 if 14 <= len(d) <= 19 and luhn(d) else -1
        known = 1 if d.startswith(CARD_FIRST) else -1
        grouped = 1 if re.fullmatch(r"[0-9]{14,19}|[0-9]{4}([ -])(?:[0-9]{4}\1)*[0-9]{2,7}", s) else -1
    elif name == "secret":
        valid = 1 if len(s) >= 20 else 0
        known = 1 if s.startswith(KEY_FIRST) else 1 if len(s) in (32, 40, 64) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else 0
        grouped = 1 if _turns(s) * 6 >= len(s) else -1
    else:
        valid = 1 if 10 <= len(d) <= 15 else -1
        known = 1 if s[:1] == "+" and d.startswith(CALLING_CODES) else -1 if s[:1] == "+" else 0
        grouped = 1 if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", s) else -1
    before = text[max(0, start - WINDOW) : start].lower()
    context = 1 if any(w in before for w in CONTEXT[name]) else -1 if any(w in before.split()[-2:] for w in AGAINST) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    return (valid, known, context, edges, grouped, min(len(d), 20) // 2, int("+" in s), int("(" in s))


LABELERS = 5


def _tallies(batches):
    """text -> (kind, base, pattern, n): counts of the votes and features of base and looser spans in a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                base = base_spans(text)
                counts.update((k, True, votes(text, a, k, b)) for a, k, b in base)
                counts.update((k, False, votes(text, a, k, b)) for a, k, b in loose_spans(text, base))
        keys = list(counts)
        columns = [pa.array([k for k, _, _ in keys], pa.int32()), pa.array([b for _, b, _ in keys], pa.bool_()), pa.array([list(v) for _, _, v in keys], pa.list_(pa.int32())), pa.array([counts[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "base", "pattern", "n"])


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 60, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation on counted vote patterns: (chance of each pattern being positive, table[kind, class, labeler, vote+1]).

    given: patterns that are known to be positive. Their number says nothing about how many of the others are.
    """
    given = np.zeros(len(n), bool) if given is None else given
    p = np.where(given, 1.0, np.clip(0.5 + 0.12 * vote.sum(1), 0.05, 0.95))
    table = np.zeros((len(KINDS), 2, vote.shape[1], 3))
    for _ in range(rounds):
        log = np.zeros((len(n), 2))
        for k in range(len(KINDS)):
            rows = kind == k
            for c, w in enumerate(((1 - p) * n, p * n)):
                for j in range(vote.shape[1]):
                    # a labeler is taken to be right more often than wrong before anything is seen
                    prior = np.array([3.0, 2.0, 1.0]) if c == 0 else np.array([1.0, 2.0, 3.0])
                    t = np.bincount(vote[rows, j] + 1, w[rows], 3) + prior
                    table[k, c, j] = t / t.sum()
                open_ = rows & ~given
                log[rows, c] = np.log((w[open_].sum() + 1.0) / (n[open_].sum() + 2.0)) + sum(np.log(table[k, c, j][vote[rows, j] + 1]) for j in range(vote.shape[1]))
        p = np.where(given, 1.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
    return p, table


def features(kind: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    cols = [kind[:, None] == np.arange(len(KINDS))]
    cols += [(pattern[:, j : j + 1] == np.array([-1, 1])) for j in range(LABELERS)]
    cols += [pattern[:, LABELERS : LABELERS + 1] == np.arange(11), pattern[:, LABELERS + 1 :] == 1, np.ones((len(kind), 1))]
    return np.concatenate(cols, 1).astype(float)


def train(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier: logistic regression on patterns, weighted by the square root of their counts, by Newton's method."""
    x, w = features(kind, pattern), np.zeros(features(kind[:1], pattern[:1]).shape[1])
    weight = np.sqrt(n)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - q)) - ridge * w
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Classifier weights from the vote patterns of all documents (their number is bounded, whatever the input)."""
    rows = docs.select("text").mapInArrow(tidy(_tallies), "kind int, base boolean, pattern array<int>, n long").groupBy("kind", "base", "pattern").agg(F.sum("n").alias("n")).collect()
    return weights_of([(r.kind, r.base, tuple(r.pattern), r.n) for r in rows])


def weights_of(tallies: list[tuple[int, bool, tuple[int, ...], int]]) -> np.ndarray:
    """Classifier weights from (kind, base, pattern, n)."""
    if not tallies:
        return np.zeros(features(np.zeros(1, int), np.zeros((1, LABELERS + 3), int)).shape[1])
    kind, base, pattern, n = (np.array(c) for c in zip(*sorted(tallies), strict=True))
    p, _ = reliabilities(kind, pattern[:, :LABELERS], n.astype(float), given=base)
    return train(kind, pattern, n.astype(float), p)


def _found(weights: np.ndarray, names: list[str]):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            counts, total, base_text, all_text, clean = [[] for _ in BASE], [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = []
                for a, k, b in loose_spans(text, base) if text else ():
                    v = votes(text, a, k, b)
                    if (k, v) not in cache:
                        cache[k, v] = bool((features(np.array([k]), np.array([v])) @ weights)[0] > 0)
                    if cache[k, v]:
                        more.append((a, k, b))
                for k in range(len(BASE)):
                    counts[k].append(sum(x[1] == k for x in base))
                every = sorted(base + more)
                total.append(len(every))
                base_text.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                all_text.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in every))
                if every:
                    out, done = [], 0
                    for a, k, b in every:
                        if a >= done:
                            out += [text[done:a], f"[{KINDS[k].upper()}]"]
                        done = max(done, b)
                    text = "".join(out) + text[done:]
                clean.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(total, pa.int64()), pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(clean, pa.string())],
                names=[*names, *(f"n_{k}" for k in BASE), "n_spans", "base_spans", "spans", "redacted_text"],
            )

    return run


def find_pii(docs: DataFrame, keep: tuple[str, ...] = (), weights: np.ndarray | None = None) -> DataFrame:
    """Personal data in every text.

    Returns doc_id, text, the columns in ``keep``, n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base_spans and
    spans as kind:start:end lists in code points, and redacted_text with a kind's name for each span. A null text has no
    spans and stays null, an empty one has none. Repeated rows and equal or null doc_ids are judged each by its text.
    Columns that are not in ``keep`` are left out, whatever their names. An empty table gives no rows.
    """
    names = ["doc_id", "text", *keep]
    weights = fit(docs) if weights is None else weights
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(tidy(_found(weights, names)), types + "".join(f", n_{k} long" for k in BASE) + ", n_spans long, base_spans string, spans string, redacted_text string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents; n_spans counts all spans, also those that the method adds."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")
