"""Personal data by weak supervision.

Labelers (a strict pattern, a gazetteer, the words before a span, its shape) vote on every candidate span or abstain.
Counts of vote patterns over all documents feed an expectation-maximisation that estimates each labeler's
reliability; its posteriors train a logistic span classifier, which decides on the candidates beyond the base spans.
The base spans (four fixed patterns with their checks) are always kept.

What reaches the driver is the count of each distinct feature key. A key is a kind, four votes of three values and three
small buckets, so there are at most 9 * 81 * 6 * 3 * 3 keys whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "ssn", "local_phone", "hidden_email", "name")
KINDS = BASE_KINDS + EXTRA_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the first digit of a run fails from its other digits too, so runs are entered at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that pass its check, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


_SECRET_WORDS = ("token", "secret", "key", "passw")
_SECRET = re.compile(r"(?i:token|secret|api[_-]?key|key|password|passwd)[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9+/_=-]{8,})")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_HIDDEN_AT = ("(at)", "[at]")
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++) ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+")
#: Titles before a person's name; fixed values of the name gazetteer.
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr ", "Frau ", "Señor ", "Señora ", "Madame ", "Monsieur ")
_NAME = re.compile(r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Señora|Señor|Madame|Monsieur) ?([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)")
#: Common given names; fixed values of the name gazetteer.
GIVEN = frozenset(
    "james john robert michael william david richard joseph charles daniel matthew mark steven andrew george edward brian kevin jason mary patricia jennifer linda elizabeth susan jessica sarah karen nancy lisa margaret sandra ashley emily laura helen anna emma hans peter klaus juergen wolfgang stefan andreas matthias markus ursula monika petra sabine heike claudia katrin birgit jean pierre michel philippe alain nicolas julien marie nathalie isabelle sylvie catherine sophie camille claire luis carlos juan jose antonio miguel javier fernando carmen ana sofia isabel pilar lucia elena maria paul thomas martin alexander".split()
)
#: Top-level domains that mark an address as real or as an example.
TLDS = frozenset("com org net edu gov io de fr es uk info eu".split())
#: Known prefixes of access tokens.
PREFIXES = ("ghp_", "gho_", "sk-", "AKIA", "xox", "AIza", "eyJ")
#: Words before a span that speak for its kind, and words that speak against personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf"),
    "secret": ("token", "secret", "key", "passw", "auth", "bearer"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "anruf"),
    "hidden_email": ("mail", "contact", "write", "kontakt", "correo"),
    "name": ("dear", "contact", "by", "from", "author", "signed"),
}
AGAINST = ("version", "isbn", "issn", "page", "serial", "commit", "sha", "section", "article")


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of further kinds that meet no base span and not each other."""
    out: list[Span] = []
    low = text.lower() if any(w in text for w in ("=", ":")) else ""
    if any(w in low for w in _SECRET_WORDS):
        out += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    if "-" in text and _DIGIT.search(text):
        out += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "local_phone") for m in _LOCAL_PHONE.finditer(text)]
    if any(w in text for w in _HIDDEN_AT):
        out += [(m.start(), m.end(), "hidden_email") for m in _HIDDEN.finditer(text)]
    if any(w in text for w in TITLES):
        out += [(m.start(1), m.end(1), "name") for m in _NAME.finditer(text)]
    if not out:
        return out
    kept: list[Span] = []
    starts, ends, most = [s for s, _, _ in base], [], 0
    for _, e, _ in base:
        most = max(most, e)
        ends.append(most)
    for s in sorted(out, key=lambda s: (s[0], _ORDER[s[2]])):
        before = bisect_left(starts, s[1])  # base spans that begin before this one ends
        if (not before or ends[before - 1] <= s[0]) and (not kept or s[0] >= kept[-1][1]):
            kept.append(s)
    return kept


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(text: str, span: Span) -> tuple[int, int, int, int]:
    """1 for, 0 against, -1 abstains: strict pattern, gazetteer, context, shape."""
    start, end, kind = span
    s = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0 if any(w in before for w in AGAINST) else -1
    digits = _digits(s)
    gaz = -1
    if kind in ("email", "hidden_email"):
        strict = int(len(s) <= 254 and ".." not in s)
        gaz = int(re.split(r"[.\])\s]", s)[-1].lower() in TLDS)
        shape = int(any(c.isalpha() for c in s))
    elif kind == "ip":
        strict = int(not any(len(p) > 1 and p[0] == "0" for p in s.split(".")))
        gaz = 0 if s.split(".")[0] in ("0", "127", "255") else -1
        shape = int(len(set(s.split("."))) > 1)
    elif kind == "card":
        strict = int(len(digits) in (14, 15, 16, 19))
        gaz = 1 if digits[0] in "3456" else 0
        shape = int(len(set(digits)) > 3)
    elif kind in ("phone", "local_phone"):
        strict = int(10 <= len(digits) <= 13)
        gaz = 0 if digits[:3] in ("000", "123") else -1
        shape = int(len(set(digits)) > 2)
    elif kind == "secret":
        strict = int(bool(re.fullmatch(r"[0-9a-fA-F]{32,}|[A-Za-z0-9+/_=-]{20,}", s)))
        gaz = 1 if s.startswith(PREFIXES) else -1
        shape = int(_entropy(s) > 2.5 and any(c.isdigit() for c in s))
    elif kind == "ssn":
        strict = int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
        shape = int(len(set(digits)) > 3)
    else:
        strict = int(" " in s)
        gaz = 1 if s.split(" ")[0].lower() in GIVEN else -1
        shape = int(s[1:2].islower())
    return strict, gaz, context, shape


def key(text: str, span: Span) -> str:
    """The features of a span as one short string."""
    start, end, kind = span
    side = lambda c: "s" if not c or c.isspace() else "a" if c.isalnum() else "p"
    length = min(5, (end - start - 1) // 8)
    return "|".join([kind, *map(str, votes(text, span)), str(length), side(text[start - 1 : start]), side(text[end : end + 1])])


@dataclass(frozen=True)
class SpanModel:
    """Probability of personal data for each feature key, and the labelers' estimated reliabilities."""

    probability: dict[str, float]
    reliability: dict[str, float]


#: What share of the candidates of a kind is expected to be personal data, before any vote: base patterns are checked, others less.
PRIOR = {k: 0.9 if k in BASE_KINDS else 0.7 for k in KINDS}
#: Spans that the first guess of each reliability and of each share counts for; large corpora outvote it.
GUESS = 20.0


def _estimate(v: np.ndarray, n: np.ndarray, share: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and the labelers' chance to vote for true spans, by expectation-maximisation with a beta prior on every parameter."""
    guess = np.array([0.8, 0.3])  # votes for true spans, votes for false ones
    rate = np.repeat(guess[:, None], v.shape[1], axis=1)
    first, cast, said = share, v >= 0, v == 1
    for _ in range(rounds):
        like = np.stack([np.prod(np.where(said, r, np.where(cast, 1 - r, 1.0)), axis=1) for r in rate])
        true = share * like[0]
        post = true / np.maximum(true + (1 - share) * like[1], 1e-300)
        share = ((n * post).sum() + GUESS * first) / (n.sum() + GUESS)
        for k, w in enumerate((n * post, n * (1 - post))):
            rate[k] = ((w[:, None] * said).sum(axis=0) + GUESS * guess[k]) / ((w[:, None] * cast).sum(axis=0) + GUESS)
    return post, rate[0]


def fit(counts: dict[str, int], rounds: int = 50) -> SpanModel:
    """EM over the vote patterns of each kind (labelers independent given the truth), then a logistic classifier on all features.

    No span is a seed: base spans are kept whatever the model says, but it learns about their labelers as about any other.
    """
    if not counts:
        return SpanModel({}, {})
    keys = sorted(counts)
    parts = [k.split("|") for k in keys]
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([[int(x) for x in p[1:5]] for p in parts])
    kinds = np.array([p[0] for p in parts])
    post, reliability = np.zeros(len(keys)), {}
    for kind in KINDS:  # a labeler means something else for each kind
        own = kinds == kind
        if own.any():
            post[own], yes = _estimate(v[own], n[own], PRIOR[kind], rounds)
            reliability |= {f"{kind}.{labeler}": float(x) for labeler, x in zip(("pattern", "gazetteer", "context", "shape"), yes)}
    parts = [[*p, *(f"{p[0]}.{i}.{x}" for i, x in enumerate(p[1:5]))] for p in parts]  # votes by kind as well
    names = sorted({f"{i}={x}" for p in parts for i, x in enumerate(p)})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(keys), len(names) + 1))
    x[:, -1] = 1
    for r, p in enumerate(parts):
        for i, y in enumerate(p):
            x[r, at[f"{i}={y}"]] = 1
    w, weight = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - post)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-x @ w))
    return SpanModel(dict(zip(keys, p.tolist())), reliability)


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Votes over every candidate of every whole text; only counts of feature keys leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    t = text.as_py()
                    base = base_spans(t)
                    found.update(key(t, s) for s in (*base, *candidates(t, base)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return fit({r["key"]: r["n"] for r in rows})


def all_spans(text: str, model: SpanModel, threshold: float) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model.probability.get(key(text, s), 0.0) >= threshold]
    return base, sorted([*base, *more], key=lambda s: (s[0], _ORDER[s[2]]))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`, with counts of base spans, a digest of them, all spans as kind:start:end (code points), and their number.

    Null and empty texts have no spans. Repeated rows are each answered; null ids stay null; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, total = [], [], [], []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", model, threshold) if text.is_valid else ([], [])
                c = Counter(k for _, _, k in base)
                counts.append([c[k] for k in BASE_KINDS])
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
                total.append(len(every))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets, like <email>; all other columns and null texts stay."""

    def clean(t: str) -> str:
        out, at = [], 0
        for start, end, kind in all_spans(t, model, threshold)[1]:
            if start >= at:
                out += [t[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, t[at:]])

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            new = pa.array([clean(x.as_py()) if x.is_valid else None for x in col], col.type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return docs.mapInArrow(run, schema)
