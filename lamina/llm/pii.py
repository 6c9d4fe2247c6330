"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust the score.

The base kinds (e-mail, IPv4, card, phone) are kept whatever their score. Further proposals, IBANs, social security
numbers and national phone numbers, become spans if a checksum confirms them or their score of context reaches the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = 4

# The base patterns. A match starts at a run's start only, which a look-behind says where no other start
# could match: so no run of digits is met from each of its places.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Proposals beyond the base, and what speaks for them.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact"),
}
AGAINST = ("version", "order", "invoice", "isbn", "id", "ref", "page")
#: What a pattern alone is worth, a checksum, and a word for or against it within ``NEAR`` characters.
SCORE, CHECKED, FOR, COUNTER, NEAR = 0.3, 0.5, 0.35, 0.25, 40
THRESHOLD = 0.6


def luhn(digits: str) -> bool:
    """Each second digit from the right, doubled and cast out of nines, makes the sum a multiple of ten."""
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and domain: around each @, so no run is met from each of its places."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    if any(c.isascii() and c.isdigit() for c in set(text)):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40 and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def score(text: str, start: int, end: int, kind: int, checked: bool) -> float:
    """Pattern, checksum, and the words within ``NEAR`` characters on either side."""
    words = set(re.findall(r"[a-z-]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    return SCORE + CHECKED * checked + FOR * (not words.isdisjoint(CONTEXT[KINDS[kind]])) - COUNTER * (not words.isdisjoint(AGAINST))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals that cover what the sorted ``spans`` (start, end) cover."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def further(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the further kinds that a checksum confirms or that reach the threshold, and meet no base span.

    ``known`` is in order of start; proposals and what is covered are walked together, so the time is linear.
    """
    out: list[tuple[int, int, int]] = []
    covered = merged([(s, e) for s, _, e in known])
    for kind, pattern in ((4, _IBAN), (5, _SSN), (6, _NATIONAL)):
        at, new = 0, []
        for m in pattern.finditer(text):
            s, e = m.span()
            while at < len(covered) and covered[at][1] <= s:
                at += 1
            if at < len(covered) and covered[at][0] < e:
                continue
            checked = kind == 4 and mod97(m[0])
            if checked or (kind != 4 and score(text, s, e, kind, False) >= THRESHOLD):
                new.append((s, e))
        if new:
            out += [(s, kind, e) for s, e in new]
            covered = merged(list(merge(covered, new)))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found): one row for each row of ``docs``.

    ``found`` has (kind, start, end, text, score) of all spans, ``spans`` spells them. A null or empty text has none.
    Whole texts are scanned, in time linear in their length; offsets are code points, ends exclusive. Repeated rows give
    repeated rows, an empty table an empty one; other columns play no part.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string,score:double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans, found = [], [], []
            for x in b.column(1).to_pylist():
                x = x or ""
                own = base(x)
                every = sorted(own + further(x, own))
                for k in range(BASE):
                    counts[k].append(sum(s[1] == k for s in own))
                digest.append(hashlib.sha256(spelled(own).encode()).hexdigest())
                spans.append(spelled(every))
                found.append([{"kind": KINDS[k], "start": s, "end": e, "text": x[s:e], "score": score(x, s, e, k, k in (2, 4))} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, schema)
