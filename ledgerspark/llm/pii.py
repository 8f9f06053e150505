"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base spans (email, ip, card, phone, each by its exact rule)
and wider ones (secret, iban, ssn). Six labelers (strict pattern, gazetteer,
context words, assignment, boundary, variety of characters) vote +1, 0 or -1 on
each. All votes of the corpus are counted per vote pattern: a table of at most
7 kinds x 3^6 votes x 64 shapes rows, whatever the corpus size. Expectation-
maximisation on these counts estimates how reliable each labeler is; the
posteriors train a logistic span classifier, which decides on the wider spans.
Base spans always stay.

Defined cases: a null or empty text has no spans; equal rows get equal spans; a
corpus without candidates trains nothing and adds nothing; span offsets are code
points with exclusive ends; every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, table

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = KINDS[:4]

# The exact rules of the base kinds.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_SECRET = re.compile(r"[A-Za-z0-9_/+-]{16,}={0,2}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at be pl pt br mx ca au jp cn in ru".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2", "6011", "62", "65", "35", "36", "30", "38", "50", "56", "57", "58", "63", "67")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "972")
SECRET_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SK".split())
# Words before a span that speak for it, or against it.
CUES = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|kontakt|mailto", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|karte|carte|tarjeta|amex|paid", re.I),
    "phone": re.compile(r"phone|tel\b|call|mobile|fax|anruf|appel|llam", re.I),
    "secret": re.compile(r"token|password|passwd|secret|api.?key|key|auth|bearer|credential", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
AGAINST = re.compile(r"isbn|version|order no|invoice|figure|page|section|https?:|www\.|commit|sha|checksum", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, leftmost and non-overlapping per kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, 0, end))
            at = text.find("@", end)
        else:
            end = at + 1  # no local part may reach back over this sign
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.groups())]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no base span; they may overlap one another."""
    if not _DIGIT.search(text):
        return []
    found = [(m.start(), 4, m.end()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])]
    found += [(m.start(), 5, m.end()) for m in _IBAN.finditer(text)]
    found += [(m.start(), 6, m.end()) for m in _SSN.finditer(text)]
    out, b = [], 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while b < len(base) and base[b][2] <= s:
            b += 1
        if not (b < len(base) and base[b][0] < e):
            out.append((s, k, e))
    return out


def _strict(kind: str, span: str) -> int:
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", span) else -1
    if kind == "ip":
        return 1 if all(p == str(int(p)) for p in span.split(".")) and not span.startswith("0.") else -1
    if kind == "card":
        return 1 if len(digits) in (15, 16) else 0
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 13 else 0
    if kind == "iban":
        plain = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    if re.fullmatch("[0-9a-f]{18,128}|[0-9A-F]{18,128}|[A-Z0-9]{20}|[A-Za-z0-9_-]{24,}", span):
        return 1
    return -1 if span.count("/") > 1 or re.fullmatch("[A-Za-z]+-?[0-9]{1,4}", span) else 0


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
    if kind == "ip":
        return -1 if span.startswith(("127.", "255.", "0.")) else 0
    if kind == "card":
        return 1 if span.startswith(ISSUERS) else -1
    if kind == "phone":
        return 1 if span[1:].startswith(CALLING) else -1
    if kind == "iban":
        return 1 if span[:2] in IBAN_COUNTRIES else -1
    return 1 if kind == "secret" and span.startswith(SECRET_MARKS) else 0


def votes(text: str, kind: int, s: int, e: int) -> tuple[tuple[int, ...], int]:
    """The labelers' votes on a span and its shape (length, digits, variety, each in four steps)."""
    name, span, left = KINDS[kind], text[s:e], text[max(0, s - 32) : s]
    cue = 1 if CUES[name].search(left) else -1 if AGAINST.search(left) else 0
    tail = left.rstrip("\"' ")
    assigned = 1 if tail.endswith(("=", ":")) else 0
    edge = -1 if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) else 1
    kinds = len(set(span))
    variety = -1 if kinds * 4 < len(span) or kinds < 4 else 1 if kinds >= 8 else 0
    n, d = len(span), sum(c.isdigit() for c in span)
    shape = min(3, n // 12) * 16 + min(3, 4 * d // n) * 4 + min(3, kinds // 5)
    return (_strict(name, span), _gazetteer(name, span), cue, assigned, edge, variety), shape


N_VOTERS = 6


def _key(kind: int, vote: tuple[int, ...], shape: int) -> int:
    for v in vote:
        kind = kind * 3 + v + 1
    return kind * 64 + shape


def _unkey(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, rest = key % 64, key // 64
    vote = np.empty((len(key), N_VOTERS), np.int64)
    for j in reversed(range(N_VOTERS)):
        vote[:, j], rest = rest % 3 - 1, rest // 3
    return rest, vote, shape


def vote_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """How often each (kind, votes, shape) occurs; the key space is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for s, k, e in base + wide_spans(text, base):
                        counts[_key(k, *votes(text, k, s, e))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return map_arrow(docs.select(text_col), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit_labelers(key: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: P(vote | class) of each labeler, and each row's posterior of being personal data."""
    kind, vote, _ = _unkey(key)
    weight = n.astype(float)
    posterior = np.clip(0.5 + 0.45 * np.tanh(vote.sum(1) / 2), 0.02, 0.98)
    tables = np.zeros((N_VOTERS, 3, 2))
    for _ in range(rounds):
        both = np.stack([1 - posterior, posterior], 1) * weight[:, None]
        prior = np.full((len(KINDS), 2), 1.0)
        np.add.at(prior, kind, both)
        prior /= prior.sum(1, keepdims=True)
        score = np.log(prior[kind])
        for j in range(N_VOTERS):
            tables[j] = [[1.0, 0.2], [1.0, 1.0], [0.2, 1.0]]  # a weak prior that votes mean what they say
            np.add.at(tables[j], vote[:, j] + 1, both)
            tables[j] /= tables[j].sum(0)
            score += np.log(tables[j][vote[:, j] + 1])
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -30, 30)))
    return tables, posterior


def _features(kind: np.ndarray, vote: np.ndarray, shape: np.ndarray) -> np.ndarray:
    one = lambda x, n: np.eye(n)[x]
    return np.hstack([one(kind, len(KINDS)), *[one(vote[:, j] + 1, 3) for j in range(N_VOTERS)], one(shape // 16, 4), one(shape // 4 % 4, 4), one(shape % 4, 4)])


def fit_classifier(key: np.ndarray, n: np.ndarray, posterior: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression of the posteriors on votes, kind and shape, by Newton steps on the counted rows."""
    x, w = _features(*_unkey(key)), np.zeros(0)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - posterior)) + ridge * w
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """The span classifier's weights, from the votes of all documents."""
    rows = sorted((r["key"], r["n"]) for r in vote_counts(docs, text_col).collect())
    if not rows:
        return None
    key, n = np.array(rows, np.int64).T
    return fit_classifier(key, n, fit_labelers(key, n)[1])


def spans_of(text: str | None, weights: np.ndarray | None, threshold: float = 0.5) -> tuple[list, list]:
    """The base spans, and all spans, of one text: (start, kind, end), in order."""
    if not text:
        return [], []
    base = base_spans(text)
    wide = wide_spans(text, base) if weights is not None else []
    if wide:
        key = np.array([_key(k, *votes(text, k, s, e)) for s, k, e in wide], np.int64)
        keep = _features(*_unkey(key)) @ weights >= np.log(threshold / (1 - threshold))
        accepted, wide, end = [x for x, y in zip(wide, keep) if y], [], 0
        for s, k, e in accepted:  # of overlapping ones the first stays
            if s >= end:
                wide.append((s, k, e))
                end = e
    return base, sorted(base + wide)


def _text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, weights: np.ndarray | None = None) -> DataFrame:
    """Per row: the id, counts of the base kinds, base_sha256, spans."""
    weights = train(docs, text_col) if weights is None else weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t, weights) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == j for _, k, _ in base) for base, _ in found], pa.int64()) for j in range(4)]
            sha = pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_text(s) for _, s in found], pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", *, weights: np.ndarray | None = None) -> DataFrame:
    """docs with every span of text_col replaced; other columns as they are."""
    weights = train(docs, text_col) if weights is None else weights
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redact(t, spans_of(t, weights)[1]) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
