"""Personal data by weak supervision.

*Candidates.*  Four base kinds are found by their own rules (``email ip card phone``); further kinds
(``secret account iban national name obfuscated``) are proposed generously.
*Labelers.*  Five vote on every candidate (personal, not, or no vote): the regex's strict shape, a
checksum, a gazetteer, the words before, and the characters at its edges.
*Aggregation.*  Vote patterns are counted over all documents (at most 3^5 per kind), and
expectation-maximisation estimates each labeler's reliability and each pattern's posterior without
any labels.
*Classifier.*  A logistic regression over hashed span features is trained on these posteriors, from a
bounded sample of candidates (about ``TRAIN_SPANS``, drawn by a hash of document, kind and place), and decides on every candidate of the further kinds.
Base spans stay whatever it says.

The texts are read once; what is kept of them are spans and votes (:func:`redact` reads them again to mask them).

Defined cases: null and empty texts hold nothing; offsets are code points, ends exclusive; spans of
one kind don't overlap, and a further span that touches a base span is dropped; repeated rows are
reported again; with no candidates at all, the classifier accepts nothing; further columns are ignored
by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, staged, table

BASE = ("email", "ip", "card", "phone")
FURTHER = ("secret", "account", "iban", "national", "name", "obfuscated")
KINDS = BASE + FURTHER
#: Bound on the spans that train the classifier.
TRAIN_SPANS = 20_000
FEATURES = 512
ACCEPT = 0.5
VOTERS = ("shape", "checksum", "gazetteer", "context", "edges")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_KEYED = re.compile(r"[=:] ?[\"']?([A-Za-z0-9_+/-]{20,})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?")
_OBFUSCATED = re.compile(r"([A-Za-z0-9._-]+) ?[\[(]at[\])] ?([A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+)", re.I)

#: Words that speak for a kind when they stand before it.
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "payment"},
    "phone": {"call", "phone", "tel", "fax", "mobile"},
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer"},
    "account": {"account", "konto", "acct", "card", "number"},
    "iban": {"iban", "account", "konto", "bank"},
    "national": {"ssn", "social", "security", "id"},
    "name": {"name", "dear", "contact", "by", "from"},
    "obfuscated": {"mail", "email", "contact", "write"},
}
#: Words that speak against it.
AGAINST = {"version", "isbn", "issn", "page", "figure", "table", "order", "commit", "sha1", "sha256", "md5", "doi"}
#: Given names, and ends of host names.
NAMES = {"Alice", "Anna", "Bob", "Carlos", "David", "Elena", "Emma", "Hans", "Jean", "John", "Julia", "Karl", "Laura", "Lena", "Lucas", "Maria", "Marie", "Max", "Michael", "Paul", "Peter", "Pierre", "Sofia", "Thomas"}
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the email pattern finds; looking back from each @ keeps it linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() >= 7 and text.count(".", run.start(), run.end()) >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
                    out.append(m.span())
    return out


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Spans of the base kinds, and numbers of a card's length that fail its checksum."""
    cards, others, phones = [], [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                (cards if luhn(digits) else others).append(m.span())
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return {"email": emails(text), "ip": ips(text), "card": cards, "phone": phones}, others


def further_spans(text: str, base: dict[str, list[tuple[int, int]]], failed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    found = [("account", a, b) for a, b in failed]
    found += [("secret", *m.span(1)) for m in _KEYED.finditer(text)]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    found += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
    found += [("name", *m.span()) for m in _NAME.finditer(text)]
    if "(at)" in (low := text.lower()) or "[at]" in low:
        found += [("obfuscated", *m.span()) for m in _OBFUSCATED.finditer(text)]
    taken = sorted(s for spans in base.values() for s in spans)
    found.sort(key=lambda s: (s[1], s[2]))
    out, i = [], 0
    for kind, a, b in found:  # both lists go by start; base spans of different kinds may overlap each other
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:  # the first that ends behind a tells: later ones start no earlier
            out.append((kind, a, b))
    return out


def votes_of(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """The labelers' votes: 1 personal, -1 not, 0 none."""
    span = text[a:b]
    digits = "".join(c for c in span if c in "0123456789")
    before = re.findall(r"\w+", text[max(0, a - 40) : a].lower())[-3:]
    strict = {
        "email": len(span) <= 254 and ".." not in span and not span.startswith("."),
        "ip": all(x == str(int(x)) for x in span.split(".")) if kind == "ip" else False,
        "card": len(set(span) - set(digits)) <= 1,
        "phone": 10 <= len(digits) <= 14,
        "secret": len(span) >= 32 and any(c.isdigit() for c in span) and any(c.isalpha() for c in span),
        "account": len(digits) == len(span) and 15 <= len(digits) <= 16,
        "iban": 15 <= len(span) <= 34,
        "national": span[:3] not in ("000", "666") and span[0] != "9",
        "name": span.count(" ") == 2,
        "obfuscated": True,
    }[kind]
    check = 0
    if kind in ("card", "account"):
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        check = 1 if int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1 else -1
    elif kind == "secret":
        share = [span.count(c) / len(span) for c in set(span)]
        check = 1 if -sum(p * math.log2(p) for p in share) > 3 else -1
    elif kind == "ip":
        check = -1 if span.split(".")[0] in ("0", "127", "255") else 0
    elif kind == "national":
        check = -1 if span[4:6] == "00" or span[7:] == "0000" else 0
    listed = 0
    if kind in ("email", "obfuscated"):
        listed = 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in DOMAINS else -1
    elif kind == "name":
        listed = 1 if NAMES & set(span.split()) else 0
    near = 1 if CUES[kind] & set(before) else -1 if AGAINST & set(before) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    return (1 if strict else -1, check, listed, near, edges)


def features_of(text: str, kind: str, a: int, b: int, votes: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: kind, votes, shape, size and the word before."""
    span = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-z]", "x", re.sub("[A-Z]", "X", span[:64]))))
    before = re.findall(r"\w+", text[max(0, a - 40) : a].lower())[-1:]
    names = [kind, f"{kind}|{shape[:12]}", f"{kind}|{(b - a).bit_length()}", f"{kind}|<{''.join(before)[:12]}", *[f"{v}={x}" for v, x in zip(VOTERS, votes, strict=True)]]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def pattern_code(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def votes_from(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(VOTERS))]


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: prior, P(vote | class) per labeler, and each pattern's posterior.

    It starts from the share of positive votes, which fixes which class is which; every count is smoothed by one.
    """
    n, k = patterns.shape
    positive, cast = (patterns > 0).sum(1), (patterns != 0).sum(1)
    post = (positive + 1.0) / (cast + 2.0)
    prior, table_ = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds if n else 0):
        for y, weight in ((1, post * counts), (0, (1 - post) * counts)):
            for j in range(k):
                got = np.array([weight[patterns[:, j] == v].sum() for v in (-1, 0, 1)]) + 1.0
                table_[j, y] = got / got.sum()
        prior = float(np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99))
        log = np.full((n, 2), [math.log(1 - prior), math.log(prior)])
        for j in range(k):
            log += np.log(table_[j])[:, patterns[:, j] + 1].T
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return prior, table_, post


def fit_classifier(rows: list[list[int]], target: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        w[-1] = -10.0
        return w
    flat = np.concatenate([np.array([*r, FEATURES]) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    seen = np.bincount(flat, minlength=FEATURES + 1) + 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(at, weights=w[flat], minlength=len(rows))))
        w -= rate * (np.bincount(flat, weights=(p - target)[at], minlength=FEATURES + 1) / seen + decay * w)
    return w


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int, list[int]]]]:
    """Base spans in order, and all candidates with votes and features."""
    base, failed = base_spans(text)
    listed = [(kind, a, b) for kind in BASE for a, b in base[kind]]
    candidates = []
    for kind, a, b in listed + further_spans(text, base, failed):
        votes = votes_of(text, kind, a, b)
        candidates.append((kind, a, b, pattern_code(votes), features_of(text, kind, a, b, votes)))
    return listed, candidates


SCANNED = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, candidates array<struct<kind:string,start:long,stop:long,votes:int,features:array<int>>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])


def scanned(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: base spans and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [scan(t) for t in part.column(1).to_pylist()]
                base = [[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x, _ in found]
                candidates = [[{"kind": k, "start": a, "stop": b, "votes": v, "features": f} for k, a, b, v, f in x] for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(candidates, pa.list_(_CANDIDATE))], names=["doc_id", "base", "candidates"])

    return documents_of(df, key=key, text=text).mapInArrow(run, SCANNED)


class Model:
    """Reliabilities by kind and the span classifier."""

    def __init__(self, scanned_: DataFrame, train_spans: int = TRAIN_SPANS):
        each = scanned_.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
        patterns = each.groupBy("kind", "votes").count().collect()  # at most 3^5 for each kind
        self.posterior: dict[tuple[str, int], float] = {}
        self.reliability: dict[str, np.ndarray] = {}
        for kind in KINDS:
            own = sorted((r.votes, r["count"]) for r in patterns if r.kind == kind)
            votes = np.array([votes_from(v) for v, _ in own], dtype=np.int64).reshape(-1, len(VOTERS))
            _, self.reliability[kind], post = reliabilities(votes, np.array([n for _, n in own], dtype=float))
            self.posterior |= {(kind, v): float(p) for (v, _), p in zip(own, post, strict=True)}
        # A share of all candidates, so that no partition sends more than its part; the limit is for rows that repeat.
        share = min(1.0, train_spans / max(1, sum(r["count"] for r in patterns)))
        drawn = F.pmod(F.xxhash64("doc_id", "kind", "start"), F.lit(1 << 30)) < int(share * (1 << 30))
        found = each.select("kind", "votes", "features", F.xxhash64("doc_id", "kind", "start", "stop").alias("h")).filter(drawn if share < 1 else F.lit(True)).limit(2 * train_spans).collect()
        sample = sorted(found, key=lambda r: (r.h, r.kind, r.votes))
        self.weights = fit_classifier([r.features for r in sample], np.array([self.posterior[r.kind, r.votes] for r in sample]))

    def probability(self, features: list[int]) -> float:
        return 1 / (1 + math.exp(-float(self.weights[features].sum() + self.weights[-1])))

    def spans(self, base: list[tuple[str, int, int]], candidates: list[tuple]) -> list[tuple[str, int, int]]:
        """Base spans and the accepted further ones, by kind, then start; none of a kind overlap."""
        more = sorted(((KINDS.index(k), a, b) for k, a, b, _, f in candidates if k in FURTHER and self.probability(f) >= ACCEPT), key=lambda s: (s[0], s[1], -s[2]))
        kept = more[:1] + [y for x, y in pairwise(more) if y[0] != x[0] or y[1] >= x[2]]
        return base + [(KINDS[k], a, b) for k, a, b in kept]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and all spans as arrays of (kind, start, stop)."""
    seen = staged(scanned(df, key=key, text=text))
    shared = df.sparkSession.sparkContext.broadcast(Model(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, candidates in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = shared.value.spans([(x["kind"], x["start"], x["stop"]) for x in base], [(x["kind"], x["start"], x["stop"], x["votes"], x["features"]) for x in candidates])
                out.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(_SPAN))], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,stop:long>>"
    return seen.mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redact(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in angle brackets; other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(Model(staged(scanned(df, key=key, text=text))))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else covered(t, shared.value.spans(*scan(t))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def covered(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with spans replaced; of overlapping ones the first, longest counts, up to the furthest end."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = find(table(spark, sf_dir, "documents"))
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
