"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Looser patterns propose
further candidates. Labelers (regular expressions, gazetteers, context) vote on
every candidate, for it, against it or not at all. The votes of all documents,
counted by vote pattern, go to expectation-maximisation, which estimates each
labeler's reliability without labels; its posteriors train a logistic span
classifier, which sees the votes and the span's shape and neighbours too, and
candidates that this finds likely enough join the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")

_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits whose start fails, so runs are taken whole.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SPOKEN = re.compile(r"\s+at\s+", re.I)
_NUMBER_BEFORE = re.compile(r"[0-9][\s,;|]{1,3}$")
_NUMBER_AFTER = re.compile(r"[\s,;|]{1,3}[0-9]")

# Looser candidates: kind, what the lowered text must hold (any of the strings of each group), pattern.
_DOT = r"(?:\s+dot\s+|\s?[\[({]dot[\])}]\s?|\.)"
_BREAK = r"[ ./_-]"
_LOOSE = (
    ("email", (("@", "at]", "at)", "at}"),), r"\b[A-Za-z0-9._%+-]{2,64}\s?(?:\[at\]|\(at\)|\{at\}|\s@\s|@)\s?[A-Za-z0-9-]{2,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]{2,63}){0,4}"),
    ("email", ((" at ",), ("dot",)), rf"\b[A-Za-z0-9_%+-]{{2,64}}+(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}+){{0,4}}\s+at\s+(?:[A-Za-z0-9-]{{2,63}}+{_DOT}){{0,3}}[A-Za-z0-9-]{{2,63}}+\s?[\[({{ ]dot[\])}} ]\s?[A-Za-z]{{2,24}}\b"),
    ("ip", ((":",),), r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])"),
    ("ip", (("[.]", "(.)", "{.}", "dot"),), r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:[\[({]\.[\])}]|[\[({]dot[\])}]|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9])"),
    ("card", (), rf"(?<![0-9])[0-9]{{4}}(?:{_BREAK}{{0,2}}[0-9]{{4}}){{2}}{_BREAK}{{0,2}}[0-9]{{1,7}}(?![0-9])"),
    ("card", (), rf"(?<![0-9])3[47][0-9]{{2}}{_BREAK}{{1,2}}[0-9]{{6}}{_BREAK}{{1,2}}[0-9]{{5}}(?![0-9])"),
    ("phone", (), r"(?<![0-9+])(?:\+[0-9]{1,3}[ ./-]{0,2})?(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9])"),
    ("phone", (), r"(?<![0-9+.])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])"),
    ("phone", (), r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[ ./-]{1,2}[0-9]{2,5}){2,4}(?![0-9])"),
    ("phone", (), r"(?<![0-9+])(?:\(0[1-9][0-9]{1,4}\)|0[1-9][0-9]{1,4}) ?[/ -] ?[0-9]{5,9}(?![0-9])"),
)
_LOOSE = tuple((KINDS.index(kind), needs, re.compile(pattern, re.I)) for kind, needs, pattern in _LOOSE)
_CONTEXT = {
    "email": re.compile(r"e-?mail|mailto|correo|courriel|contact|kontakt", re.I),
    "ip": re.compile(r"\bip\b|\bhost\b|server|address|adresse|client", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|tarjeta|carte|karte|kredit|credit", re.I),
    "phone": re.compile(r"\btel|phone|fono|telefon|mobil|\bcell|\bcall|\bfax|whatsapp", re.I),
}
_AGAINST = re.compile(r"token|secret|key|hash|isbn|issn|doi|version|\bv\s*$|order|serial|build|=\s*\"?$|#\s*$", re.I)
#: Frequent endings of domains.
_DOMAIN_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum mobi asia jobs tel travel cat app dev io ai co me tv cc "
    "at au be br ca ch cl cn cz de dk es eu fi fr gr hk hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za".split()
)
#: Words that stand before `at` without being an address.
_NO_NAME = frozenset(
    "a an and are arrive be buy call found from good have here him hosted is it join live look looked looking me meet more not "
    "now on online only open out page read see shop site start stay them there this us visit was watch we web website you".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _EMAIL_DOMAIN.match(text, at) if lo < at else None
        if m:
            done = m.end()
            out.append((0, lo, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that overlap no base span, and none found before."""
    taken = [(s, e) for _, s, e in base]
    out = []
    digits, lowered = _DIGIT.search(text), text.lower()
    for kind, needs, pattern in _LOOSE:
        # what the pattern cannot match without
        if not (digits or kind == 0 or ":" in text) or not all(any(x in lowered for x in group) for group in needs):
            continue
        starts, ends = merged(taken)  # matches of one pattern never overlap each other
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end()) - 1
            if before < 0 or ends[before] <= m.start():
                out.append((kind, m.start(), m.end()))
                taken.append(m.span())
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data of this kind, -1 against, 0 none."""
    name, span = KINDS[kind], text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    digits = _NO_DIGIT.sub("", span)
    if name == "card":
        valid = 1 if luhn(digits) and 13 <= len(digits) <= 19 else -1
        listed = 1 if digits[:1] in ("4", "5", "6") or digits[:2] in ("34", "37") else -1
    elif name == "ip":
        parts = _NO_DIGIT.split(span) if ":" not in span else []
        valid = 1 if strict or (all(int(p) <= 255 for p in parts) if parts else span.count(":") == 7 or "::" in span) else -1
        listed = 0
    elif name == "phone":
        valid = 1 if 9 <= len(digits) <= 15 else -1
        listed = 1 if span[0] in "+(" or span.startswith("00") else 0 if span[0] == "0" else -1
    else:
        local = _SPOKEN.split(span, maxsplit=1)[0] if _SPOKEN.search(span) else ""
        nobody = local.lower() in _NO_NAME or (local and not re.search(r"[^\W\d_]", local))
        ending = re.split(r"[^A-Za-z]+", span.lower().rstrip(")]} ."))[-1]
        named = re.search(r"[\[({]at[\])}]", span, re.I) or re.search(r"[0-9._%+-]|\bdot\b", local, re.I)
        # a bare word before a spoken `at` is more often a verb than an address
        valid = 1 if strict else -1 if nobody or (local and not named) else 1 if named else 0
        listed = 1 if ending in _DOMAIN_ENDINGS and not nobody else -1
    return (
        1 if strict else 0,
        valid,
        listed,
        1 if _CONTEXT[name].search(before) else 0,
        -1 if _AGAINST.search(before[-16:]) else 0,
        -1 if (after[:1].isalnum() or before[-1:].isalnum()) else 0,
        # a number among numbers, as in tables
        -1 if name != "email" and _NUMBER_BEFORE.search(before[-16:]) and _NUMBER_AFTER.match(text, end) else 0,
        # digits that are all alike or nearly
        -1 if name in ("card", "phone") and len(set(digits)) <= 2 else 0,
    )


N_LABELERS = 8
#: Values of each part of a span's shape.
SHAPE = (4, 3, 3, 3)


def shape(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """The span's size, its kinds of separators, and what stands before and after it, each as a small number."""
    span = text[start:end]
    size, steps = (len(span), (12, 20, 32)) if kind < 2 else (sum("0" <= c <= "9" for c in span), (9, 12, 16))

    def beside(c: str) -> int:
        return 0 if not c or c.isspace() else 2 if c.isalnum() else 1

    return (sum(size >= x for x in steps), min(2, len({c for c in span if not c.isalnum()})), beside(text[start - 1 : start] if start else ""), beside(text[end : end + 1]))


def described(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """What the classifier sees of a span: its votes and its shape."""
    return (*votes(text, kind, start, end, strict), *shape(text, kind, start, end))


@dataclass
class SpanModel:
    """Logistic weights over kind, votes and shape, and the reliabilities that EM found."""

    weights: np.ndarray
    reliability: np.ndarray
    known: dict = field(default_factory=dict)  # few patterns make up most spans

    def probability(self, kind: int, seen: tuple[int, ...]) -> float:
        if (kind, seen) not in self.known:
            self.known[kind, seen] = float(1 / (1 + np.exp(-(_features(kind, seen) @ self.weights))))
        return self.known[kind, seen]


N_FEATURES = 1 + len(KINDS) + 2 * N_LABELERS + len(KINDS) * SHAPE[0] + sum(SHAPE[1:])


def _features(kind: int, seen: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    x[0] = x[1 + kind] = 1
    at = 1 + len(KINDS)
    for j, v in enumerate(seen[:N_LABELERS]):
        if v:
            x[at + 2 * j + (v < 0)] = 1
    at += 2 * N_LABELERS
    size, *others = seen[N_LABELERS:]
    x[at + kind * SHAPE[0] + size] = 1  # sizes are told apart by kind
    at += len(KINDS) * SHAPE[0]
    for v, values in zip(others, SHAPE[1:], strict=True):
        x[at + v] = 1
        at += values
    return x


def learn(patterns: dict[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> SpanModel:
    """EM over the votes of counted patterns, then a logistic fit of the whole patterns to its posteriors.

    A labeler that votes is right with its own reliability; a Beta(8, 2) prior
    keeps it better than chance where votes are few, which also fixes which of
    the two classes is which. Each kind has its own prevalence, base spans and
    looser candidates apart.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    group = np.array([2 * k[0] + k[1][0] for k in keys], int)
    v = np.array([k[1][:N_LABELERS] for k in keys], int).reshape(-1, N_LABELERS)
    right, prior = np.full(N_LABELERS, 0.8), np.full(2 * len(KINDS), 0.5)
    post = np.zeros(len(keys))
    for _ in range(rounds if len(keys) else 0):
        log = np.log(right / (1 - right))
        logit = np.log(prior / (1 - prior))[group] + v @ log
        post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        agree = (n[:, None] * ((v == 1) * post[:, None] + (v == -1) * (1 - post[:, None]))).sum(0)
        cast = (n[:, None] * (v != 0)).sum(0)
        right = np.clip((agree + 8) / (cast + 10), 0.55, 0.98)
        prior = np.array([(n[group == g] @ post[group == g] + 1) / (n[group == g].sum() + 2) for g in range(2 * len(KINDS))])
        prior = np.clip(prior, 0.02, 0.98)
    x = np.array([_features(*k) for k in keys]).reshape(-1, N_FEATURES)
    w = np.zeros(x.shape[1])
    total = max(1.0, n.sum())
    for _ in range(300):  # damped Newton steps on the weighted log loss with an L2 penalty
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (n * (p - post)) / total + 1e-3 * w
        curve = (x * (n * p * (1 - p) / total)[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(w, right)


def count_votes(docs: DataFrame) -> dict[tuple[int, tuple[int, ...]], int]:
    """How often each pattern of votes and shape occurs in all documents: at most 576 * 108 patterns a kind, some hundreds in practice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                base = base_spans(text)
                for strict, spans in ((True, base), (False, loose_spans(text, base))):
                    found.update((k, *described(text, k, s, e, strict)) for k, s, e in spans)
        yield pd.DataFrame([(",".join(map(str, p)), n) for p, n in found.items()], columns=["pattern", "n"]).astype({"pattern": str, "n": "int64"})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n")).collect()
    counted = {tuple(map(int, p.split(","))): n for p, n in rows}
    return {(p[0], p[1:]): n for p, n in counted.items()}


def all_spans(text: str, model: SpanModel, least: float = 0.9) -> tuple[list, list]:
    """The base spans, and these with the likely candidates, each by kind and start."""
    base = base_spans(text)
    added = [c for c in loose_spans(text, base) if model.probability(c[0], described(text, *c, False)) >= least]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row.

    Null texts count as empty; without spans base_sha256 is that of the empty
    string and spans is empty. Repeated rows and null ids are rows like any
    other; a very long text is searched whole, in time linear to its length. An
    empty table gives an empty result; further columns are ignored.
    """
    model = learn(count_votes(docs))

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in columns}
        for text in texts:
            base, every = all_spans(text, model, least)
            n = Counter(k for k, _, _ in base)
            row = (n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))
            for c, v in zip(columns, row, strict=True):
                out[c].append(v)
        return out

    columns = {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string"}
    return map_texts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"], ["text"], run, columns)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, _, end, kind in sorted((s, -e, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """`docs` with personal data masked in text, all columns kept.

    A null text stays null, an empty one empty; a very long text is masked
    whole. Repeated rows and null ids are rows like any other, an empty table
    gives an empty one. Further columns stay as they are.
    """
    model = learn(count_votes(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, all_spans(t, model, least)[1]) for t in texts])

    return docs.withColumn("text", clean("text"))
