"""Personal data by weak supervision.

Strict expressions give the base spans, which always stay. Wider expressions
give further candidates: addresses with spelt-out signs, long internet addresses,
cards and phone numbers in other layouts. Five labelers vote on every candidate
(+1, -1, or 0 to abstain): the strict expression, a checksum or range, a
gazetteer, the words before it and its edges. Spark counts the votes together
with the span's shape, its number of digits and which separators it has, over all
documents; both are small numbers, so the counts fit the driver. There,
expectation-maximisation estimates how reliable each labeler is, and a logistic
regression on kind, votes and shape is trained to its posteriors. The classifier
decides about candidates that are not base spans.

Null texts count as empty. Spans are in code points, the end exclusive. Added
spans overlap neither base spans nor each other: of two that would, the first
kind as listed stays, then the first in the text. Texts of any length take time
in proportion. Repeated rows get a row each; null ids pass through; other columns
are not read, or stay in `redact`, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "check", "gazetteer", "context", "edges")
_SEPARATORS = (" ", "-", "./", "([{", ":")

_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WIDE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,4}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,14}(?![0-9])|(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9][0-9 ().-]{6,18}[0-9](?![0-9])"),
}

# Words and prefixes that the labelers look for.
TOP_LEVELS = frozenset(
    "com org net edu gov mil int info biz name pro io co me tv app dev ai eu us ca mx br ar cl uk ie de fr es pt it nl be lu ch at dk se no fi is pl cz sk hu ro"
    " bg gr tr ru ua il ae sa in pk cn hk tw jp kr sg my th vn id ph au nz za eg ng ke".split()
)
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
COUNTRY_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 380 420 971 972".split())
NEAR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel"),
}
AGAINST = ("isbn", "issn", "version", "order", "serial", "invoice", "doi", "figure")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs cost linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1  # a run of local characters never crosses an @
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _votes(kind: str, text: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    span, digits = text[a:b], "".join(_DIGIT.findall(text[a : min(b, a + 200)]))
    before = text[max(0, a - 40) : a].lower()
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", span.rstrip(".- "))[-1].lower()
        check, known = (1 if re.match("[A-Za-z0-9]", span) else -1), (1 if last in TOP_LEVELS else -1)
    elif kind == "ip":
        wide = ":" in span
        check = 1 if wide or all(int(p) <= 255 for p in span.split(".") if len(p) < 5) else -1
        known = 1 if wide or 0 < int(span.split(".")[0][-4:] or 0) < 224 else -1
    elif kind == "card":
        check, known = (1 if luhn(digits) else -1), (1 if digits.startswith(CARD_PREFIXES) else -1)
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        known = 1 if span.startswith("(") or digits.removeprefix("00").startswith(COUNTRY_CODES) else 0
    context = 1 if any(w in before for w in NEAR[kind]) else -1 if any(w in before for w in AGAINST) else 0
    edges = 1 if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else -1
    head = span[:200]
    shape = (min(len(digits), 20), *(int(any(c in head for c in some)) for some in _SEPARATORS))
    return (1 if strict else 0, check, known, context, edges, *shape)


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """Base spans and wider ones that overlap no other: (kind, start, end, strict, votes and shape)."""
    base = base_spans(text)
    out = [(k, a, b, True, _votes(k, text, a, b, True)) for k, a, b in base]
    digits = bool(_DIGIT.search(text))
    lower = None
    # Disjoint, in order: what base spans cover, then also what was added.
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for kind, wide in _WIDE.items():
        if kind == "email":
            lower = text.lower() if "dot" in text or "DOT" in text else ""
            found = wide.finditer(lower if len(lower) == len(text) else text) if "dot" in lower and "at" in lower else ()
        elif not digits or (kind == "ip" and text.count(":") < 7):
            found = ()
        else:
            found = wide.finditer(text)
        for m in found:
            a, b = m.span()
            k = bisect_left(begins, b)
            if not k or ends[k - 1] <= a:
                begins.insert(k, a)
                ends.insert(k, b)
                out.append((kind, a, b, False, _votes(kind, text, a, b, False)))
    return out


def _features(votes: tuple[int, ...]) -> list[float]:
    """Votes and shape as numbers of about one; a missing shape counts as zeros."""
    shape = (*votes[len(LABELERS) :], *(0,) * (1 + len(_SEPARATORS)))[: 1 + len(_SEPARATORS)]
    return [*votes[: len(LABELERS)], shape[0] / 10, *shape[1:]]


@dataclass(frozen=True)
class SpanModel:
    """Estimated reliabilities and the classifier's weights: bias, kinds, votes, shape."""

    prior: float
    right: dict[str, tuple[float, float]]
    weights: tuple[float, ...]

    def score(self, kind: str, votes: tuple[int, ...]) -> float:
        z = self.weights[0] + self.weights[1 + KINDS.index(kind)] + sum(w * v for w, v in zip(self.weights[1 + len(KINDS) :], _features(votes)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """EM over the votes of patterns with counts, then logistic regression to the posteriors.

    `right[labeler]` is its estimated chance of +1 for a true span and of -1 for
    a false one, where it votes. With no patterns the weights are the start values.
    """
    n = len(patterns)
    votes = np.array([p[1][: len(LABELERS)] for p in patterns], dtype=float).reshape(n, len(LABELERS))
    count = np.array([p[2] for p in patterns], dtype=float)
    yes = np.full(len(LABELERS), 0.9)
    no = np.full(len(LABELERS), 0.8)
    prior = 0.5
    q = np.full(n, 0.5)
    for _ in range(rounds if n else 0):
        up, down = votes > 0, votes < 0
        a = np.log(prior) + (up * np.log(yes) + down * np.log(1 - yes)).sum(axis=1)
        b = np.log(1 - prior) + (down * np.log(no) + up * np.log(1 - no)).sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        t, f = (q * count)[:, None], ((1 - q) * count)[:, None]
        # Pseudo-counts hold the estimates where few candidates speak.
        yes = ((t * up).sum(axis=0) + 9) / ((t * (up | down)).sum(axis=0) + 10)
        no = ((f * down).sum(axis=0) + 8) / ((f * (up | down)).sum(axis=0) + 10)
        prior = float(np.clip((t.sum() + 1) / (count.sum() + 2), 0.05, 0.95))
    last = 1 + len(KINDS) + len(LABELERS)
    x = np.zeros((n, last + 1 + len(_SEPARATORS)))
    x[:, 0] = 1
    for i, p in enumerate(patterns):
        x[i, 1 + KINDS.index(p[0])] = 1
        x[i, 1 + len(KINDS) :] = _features(p[1])
    w = np.zeros(x.shape[1])
    w[1 + len(KINDS) : last] = 1.0
    w[0] = -2.5
    start = w.copy()
    weight = np.log1p(count)  # so that rare patterns are heard
    for _ in range(30 if n else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - q)) + 0.5 * (w - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    right = {name: (round(float(yes[i]), 6), round(float(no[i]), 6)) for i, name in enumerate(LABELERS)}
    return SpanModel(prior, right, tuple(float(v) for v in w))


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, votes, n) over all documents, `votes` with the shape; at most 4 x 3**5 x 21 x 2**5 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update((kind, votes) for kind, _, _, _, votes in candidates(t.as_py() or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([",".join(map(str, k[1])) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["kind", "votes", "n"],
        )

    counted = docs.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "kind string, votes string, n long")
    return counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def fit_spans(docs: DataFrame, text: str = "text") -> SpanModel:
    """The model that the votes over all of `docs` give."""
    rows = vote_counts(docs, text).orderBy("kind", "votes").collect()
    return fit([(r["kind"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in rows])


def chosen(text: str, model: SpanModel, least: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans of a text by kind as listed, then start."""
    found = [(k, a, b) for k, a, b, strict, votes in candidates(text) if strict or model.score(k, votes) >= least]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, model: SpanModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans."""
    model = model or fit_spans(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, spans = [], [], []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                n = Counter(k for k, _, _ in base)
                counts.append([n[k] for k in KINDS])
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(chosen(t, model)))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns, pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind; null stays null, other columns stay."""
    model = model or fit_spans(docs, text)
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index(text)
        for b in batches:
            new = [None if t is None else redacted(t, chosen(t, model)) for t in (x.as_py() for x in b.column(at))]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=own)

    return docs.mapInArrow(run, docs.schema)
