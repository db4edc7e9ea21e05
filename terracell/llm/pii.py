"""Personal data: weak-supervision aggregation over candidate spans (operator 6).

Candidates are the matches of four base patterns (e-mail, IP address, payment card, phone) and
of looser ones.  Labelers - regexes, checksums, gazetteers and context words - vote +1, -1 or abstain on
each.  Vote patterns are counted over all documents; expectation-maximisation on those counts
estimates each labeler's reliability and each pattern's probability, and a logistic span
classifier is trained on them.  Base matches always stay; a looser candidate is added when the
classifier gives it ``ACCEPT`` or more and it overlaps no base match.

What reaches the driver is one count per distinct (kind, votes), at most 4 * 3**6 rows.  Documents are
mapped over twice and never shuffled.

Defined results: null and empty texts have no spans; overlapping candidates of one kind are taken
leftmost first; repeated rows give repeated results; empty tables give no rows; offsets are code
points, end exclusive; other columns are ignored; a text with many spans is swept in order, not pair by
pair, and must fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "checksum", "gazetteer", "context", "edges", "length")
ACCEPT = 0.9
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits lead, and what must not precede them is looked up from there: the search then skips by character class.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_SHORT_CARD = re.compile(r"[0-9](?<![\w.+-][0-9])(?:[ -]?[0-9]){12,14}(?![\w-])")
_LOCAL_PHONE = re.compile(r"[(0-9](?<![\w+.-][(0-9])(?:(?<=\()[0-9]{3}\) ?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_ZERO_PHONE = re.compile(r"00(?<![\w+.-]00)[1-9][0-9 ().-]{6,17}[0-9](?![\w-])")
_WORD = re.compile(r"[^\W\d_]+")

_CONTEXT = {
    "email": frozenset("email mail mails contact write correo courriel adresse kontakt contacto".split()),
    "ip": frozenset("ip host server address client from serveur adresse servidor rechner".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte kreditkarte pago".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon telefono teléfono téléphone handy anruf".split()),
}
_AGAINST = frozenset("version release license licence token sha hash isbn build section chapter serial".split())
_TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at ca au jp cn ru br in mx se no fi dk pl pt be".split())
_COUNTRY = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "354", "358", "420", "421", "886", "971", "972")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|2)|35|30[0-5]|36|38")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _has_digit(text: str) -> bool:
    return any(c in text for c in "0123456789")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four base patterns' spans; matches that fail their check are dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _has_digit(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that the base patterns may miss."""
    out = []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if text.count(":") >= 7:
        out += [("ip", *m.span()) for m in _IP6.finditer(text)]
    if not _has_digit(text):
        return out
    out += [("card", *m.span()) for m in _SHORT_CARD.finditer(text)]
    out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    out += [("phone", *m.span()) for m in _ZERO_PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 17]
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 abstains."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    words = {w.lower() for w in _WORD.findall(before)[-5:] + _WORD.findall(after)[:2]}
    if kind == "email":
        top = re.split(r"[.\])]", span)[-1].strip().lower()
        checksum, gazetteer = 0, 1 if top in _TLDS else -1
        length = 1 if 6 <= len(span) <= 80 else -1
    elif kind == "ip":
        parts = re.split(r"[.:]", span)
        checksum = 1 if ":" in span or all(p == "0" or not p.startswith("0") for p in parts) else -1
        gazetteer = -1 if parts[0] == "0" or all(len(p) == 1 for p in parts) else 0
        length = 1 if len(span) >= 9 else 0
    elif kind == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if _ISSUER.match(digits) else -1
        length = 1 if len(digits) in (15, 16) else -1
    else:
        bare = digits.removeprefix("00")
        checksum = 0
        gazetteer = 1 if any(bare.startswith(c) for c in _COUNTRY) and (strict or span.startswith("00")) else 0
        length = 1 if 10 <= len(bare) <= 13 else -1
    context = 1 if words & _CONTEXT[kind] else -1 if words & _AGAINST else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() or left == "_" or right == "_" else 1
    return (1 if strict else 0, checksum, gazetteer, context, edges, length)


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    base = base_spans(text)
    out = [(k, a, b, True, votes(text, k, a, b, True)) for k in KINDS for a, b in base[k]]
    taken = _merged((a, b) for k in KINDS for a, b in base[k])
    for k, a, b in loose_spans(text):
        if not _meets(taken, a, b):
            out.append((k, a, b, False, votes(text, k, a, b, False)))
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that don't overlap and cover what the given ones do."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span overlaps one of sorted spans that don't overlap each other."""
    at = bisect_left(taken, (b, -1))
    return at > 0 and taken[at - 1][1] > a


class SpanModel:
    """Labeler reliabilities by EM on counted vote patterns, and a logistic classifier of patterns."""

    def __init__(self, counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 100):
        self.w = None
        if not counts:
            return
        keys = sorted(counts)
        n = np.array([counts[k] for k in keys], float)
        kind = np.array([KINDS.index(k) for k, _ in keys])
        v = np.array([x for _, x in keys]) + 1  # 0, 1, 2
        p = 1 / (1 + np.exp(-(v - 1).sum(axis=1) * 1.5))
        for _ in range(rounds):
            prior = np.array([((n * p)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
            score = np.log(prior / (1 - prior))[kind]
            self.reliability = []
            for j in range(v.shape[1]):
                yes = np.array([(n * p)[v[:, j] == o].sum() + 1 for o in range(3)])
                no = np.array([(n * (1 - p))[v[:, j] == o].sum() + 1 for o in range(3)])
                # a labeler is never taken to be worse than chance, which keeps the two classes apart
                ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
                ratio = np.array([min(ratio[0], 0), np.clip(ratio[1], -0.5, 0.5), max(ratio[2], 0)])
                self.reliability.append(ratio)
                score = score + ratio[v[:, j]]
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            if np.abs(new - p).max() < 1e-7:
                break
            p = new
        x = self._x(kind, v)
        w = np.zeros(x.shape[1])
        weight = n / n.sum()
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (q - p)) + 1e-4 * w
            h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    @staticmethod
    def _x(kind: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.column_stack([np.eye(len(KINDS))[kind], *[np.eye(3)[v[:, j]] for j in range(v.shape[1])]])

    def probability(self, kind: str, vote: tuple[int, ...]) -> float:
        if self.w is None:
            return 0.0
        x = self._x(np.array([KINDS.index(kind)]), np.array([vote]) + 1)
        return float(1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))[0])


def _count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    for batch in batches:
        for text in common.texts(batch):
            n.update((k, v) for k, _, _, _, v in candidates(text))
    yield pa.record_batch([pa.array([k for k, _ in n], pa.string()), pa.array([list(v) for _, v in n], pa.list_(pa.int32())), pa.array(list(n.values()), pa.int64())], names=["kind", "votes", "n"])


def fit(docs: DataFrame) -> SpanModel:
    """Estimates the model from the votes on all documents' candidates."""
    counted = common.arrow_map(docs.select("text"), _count_votes, "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return SpanModel({(r["kind"], tuple(r["votes"])): r["n"] for r in counted.collect()})


def spans_of(text: str, model: SpanModel, known: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as in KINDS, then start."""
    base, added = [], []
    for kind, a, b, strict, vote in candidates(text):
        if strict:
            base.append((kind, a, b))
            continue
        if (key := (kind, vote)) not in known:
            known[key] = model.probability(kind, vote)
        if known[key] >= ACCEPT:
            added.append((-known[key], a, b, kind))
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for _, a, b, kind in sorted(added):
        if not _meets(taken, a, b):
            insort(taken, (a, b))
            kept.append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + kept, key=order)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in common.texts(batch):
                base, spans = spans_of(text, model, known)
                n = Counter(k for k, _, _ in base)
                row = [*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(own, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text.

    All columns stay; where spans of different kinds overlap, their union is replaced by the first one's kind.
    """
    model = model or fit(docs)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, sizes = [], batch.column("n_chars").to_pylist() if "n_chars" in names else [None] * len(texts)
            for i, text in enumerate(texts):
                spans = sorted(spans_of(text, model, known)[1], key=lambda s: (s[1], s[2])) if text else []
                at, parts, end = 0, [], 0
                for kind, a, b in spans:
                    if a >= end:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = end = max(end, b)
                if spans:
                    text = "".join([*parts, text[at:]])
                    sizes[i] = len(text)
                out.append(text)
            new = {"text": out, "n_chars": sizes}
            yield pa.record_batch([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return common.arrow_map(docs, run, schema)
