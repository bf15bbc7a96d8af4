"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Patterns run over whole texts in linear time: maximal digit and address runs are found first, so a very long run
is read once and not from each of its starts. Spans are code points, end exclusive.

Defined cases: a null or empty text has no spans; rows are independent, so repeated rows give repeated results and an
empty table an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_LEAST = 15
_DIGIT = re.compile(r"[0-9]")

# Words that make a kind more or less likely when they stand within CONTEXT characters before a span.
CONTEXT = 40
CUES = {
    "email": re.compile(r"(?i)\b(mail|e-mail|email|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|debit|payment|pay)\b"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|mobile|fax)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|transfer)\b"),
}
COUNTER_CUES = re.compile(r"(?i)\b(version|release|isbn|order|sample|example|test)\b")
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        if len(parts) < 4:
            continue
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base kinds in order of start, then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(a, 1, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Account numbers whose mod-97 checksum holds: from each start the longest one that ends with a token."""
    found: list[tuple[int, int, int]] = []
    if not _DIGIT.search(text):
        return found
    m = _IBAN.search(text)
    while m:
        run, at = m.group(), m.start() + 1
        ends = [len(run), *(k for k in range(len(run) - 1, 0, -1) if run[k] == " ")]
        for end in ends:
            number = run[:end].replace(" ", "")
            if len(number) < _IBAN_LEAST:
                break
            if mod97(number):
                found.append((m.start(), 4, m.start() + end))
                at = m.start() + end
                break
        m = _IBAN.search(text, at)
    return found


def score(text: str, start: int, kind: int) -> float:
    """Prior of the kind, raised by a cue word before the span and lowered by a counter cue."""
    before, name = text[max(0, start - CONTEXT):start], KINDS[kind]
    value = PRIOR[name] + 0.2 * bool(CUES[name].search(before)) - 0.3 * bool(COUNTER_CUES.search(before))
    return min(1.0, max(0.0, value))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each covered run replaced by the tag of its first span."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SCHEMA = ("{key}, n_email long, n_ip long, n_card long, n_phone long, n_iban long, base_sha256 string, spans string, "
           "max_score double")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts by kind, digest of the base spans, all spans, highest score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for value in batch.column(1):
                body = value.as_py() or ""
                base = base_spans(body)
                every = sorted(base + added_spans(body))
                for k in range(5):
                    rows[k].append(sum(s[1] == k for s in every))
                rows[5].append(hashlib.sha256(listed(base).encode()).hexdigest())
                rows[6].append(listed(every))
                rows[7].append(max((score(body, a, k) for a, k, _ in every), default=0.0))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(r, t) for r, t in zip(rows, kinds)]],
                names=[key, "n_email", "n_ip", "n_card", "n_phone", "n_iban", "base_sha256", "spans", "max_score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, _SCHEMA.format(key=f"`{key}` {kind}"))


def redact_texts(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows with spans of at least ``least`` score replaced by tags; other columns pass through."""
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(place):
                body = value.as_py()
                spans = [] if not body else [s for s in sorted(base_spans(body) + added_spans(body))
                                             if score(body, s[0], s[1]) >= least]
                out.append(redact(body, spans) if spans else body)
            columns = [pa.array(out, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def redact_documents(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``documents`` with redacted texts and their length as ``n_chars``, the columns in the given order."""
    clean = redact_texts(docs, least=least)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
