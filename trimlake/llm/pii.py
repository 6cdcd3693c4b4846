"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Four base kinds (email, ip, card, phone) have fixed definitions and always stay. The method adds spans of further kinds: a
proposal starts from its pattern's score, a checksum (mod-97 for IBANs, Luhn for spaced card numbers, area rules for
social security numbers, a least entropy for keys and tokens) confirms or rejects it, and words near it raise the score; it is reported from ACCEPT on, unless it
overlaps a base span or an added one that starts earlier.

Every pattern runs in time linear in the text. Positions are code points, the end exclusive. Defined results: a null or
empty text has no spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from trimlake.llm.common import tune

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "card_split", "phone_local", "secret")
_RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Possessive, and from the start of a run of digits: a later start in the same run fails where the first one fails.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_CARD_SPLIT = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")

#: Words that raise a kind's score, by how much, and how far to look on either side (code points).
CONTEXT = {
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "card_split": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "portable"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "bearer", "auth", "credential"),
}
CONTEXT_GAIN = 0.4
CONTEXT_REACH = 48
#: Score of a confirmed span without context.
CONFIRMED = {"iban": 0.9, "ssn": 0.3, "card_split": 0.5, "phone_local": 0.3, "secret": 0.4}
ACCEPT = 0.6
#: Bits a character that a key or token holds at least (repeated signs hold fewer).
ENTROPY = 3.0
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def random_looking(s: str) -> bool:
    """Whether a run of signs has letters, a tenth of digits, and the entropy of a key."""
    n = Counter(s)
    digits = sum(k for c, k in n.items() if c.isdigit())
    return any(c.isalpha() for c in n) and 10 * digits >= len(s) and sum(k * math.log2(len(s) / k) for k in n.values()) >= ENTROPY * len(s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs: the local part is the whole run before one, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # no match reaches over this sign
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [Span("ip", m.start(), m.end(), 1.0) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(Span("card", m.start(), m.end(), 1.0))
        if "+" in text:
            out += [Span("phone", m.start(), m.end(), 1.0) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s.start, _RANK[s.kind]))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        # The pattern may run on into following words: the longest confirmed prefix counts.
        for end in [m.end(), *(m.start() + k for k in sorted((i for i, c in enumerate(m[0]) if c == " "), reverse=True))]:
            if mod97(text[m.start() : end]):
                yield "iban", m.start(), end
                break
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _CARD_SPLIT.finditer(text):
        if luhn(m[0].replace(m[1], "")):
            yield "card_split", m.start(), m.end()
    for m in _PHONE_LOCAL.finditer(text):
        yield "phone_local", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if random_looking(m[0]):
            yield "secret", m.start(), m.end()


def context_score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_REACH) : start] + " " + text[end : end + CONTEXT_REACH // 2]
    words = {w.lower() for w in _WORD.findall(near)}
    return CONFIRMED[kind] + CONTEXT_GAIN * bool(words & set(CONTEXT[kind]))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, in order."""
    if not text:
        return []
    base = base_spans(text)
    if not _DIGIT.search(text):
        return base
    starts = [s.start for s in base]
    reach = [0, *accumulate((s.end for s in base), max)]  # of the base spans up to each one
    added: list[Span] = []
    for kind, a, b in sorted(_proposals(text), key=lambda p: (p[1], _RANK[p[0]])):
        if reach[bisect_left(starts, b)] > a or added and a < added[-1].end:
            continue
        score = context_score(kind, text, a, b)
        if score >= ACCEPT:
            added.append(Span(kind, a, b, min(score, 1.0)))
    return sorted(base + added, key=lambda s: (s.start, _RANK[s.kind]))


def redact(text: str | None) -> str | None:
    """The text with each span, or overlapping run of spans, replaced by its first kind in angle brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, a, b, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1].start < b:
            k += 1
            b = max(b, spans[k].end)
        out += [text[done:a], f"<{kind}>"]
        done = b
        k += 1
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


FIELDS = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, scores string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            spans = find_spans(text)
            base = [s for s in spans if s.kind in BASE_KINDS]
            kinds = [s.kind for s in base]
            rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), ",".join(f"{s.score:.2f}" for s in spans)))
        cols = list(zip(*rows)) if rows else [()] * 8
        kinds_ = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds_))], [f.split()[0] for f in FIELDS.split(", ")])


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row a document with its counts and spans; scores: of each span, in the order of spans. One pass, no shuffle."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, FIELDS.format(docs.schema["doc_id"].dataType.simpleString()))


def redact_table(docs: DataFrame) -> DataFrame:
    """docs with the spans of its text replaced; all other columns as they are."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redact(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield b.set_column(at, b.schema.field(at).name, new)

    return docs.mapInArrow(change, docs.schema)


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
