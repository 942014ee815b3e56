"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Kinds: email, ip, card, phone (always kept once their checks pass), and two that the method adds:
``iban`` (country length and mod-97) and ``card_short`` (13 to 15 digits that pass Luhn), kept if
their score, raised or lowered by words nearby, reaches ``KEEP``.  Matching is leftmost and
non-overlapping for each kind; words nearby count whole ("ip" is no part of "ship").  A proposal that fails its check is dropped without another try.
All searches take time linear in the text.  Offsets count code points, end exclusive.

Defined cases: null and empty texts have no spans; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, map_texts, texts_of

KEEP = 0.5
NEAR = 48
KINDS = ("email", "ip", "card", "phone", "iban", "card_short")
BASE = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W_]+")

#: IBAN length for each country code.
_IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "AD": 24, "AE": 23, "AL": 28, "AZ": 28, "BA": 20,
    "BH": 22, "BR": 29, "CR": 22, "DO": 28, "EG": 29, "FO": 18, "GE": 22, "GI": 23, "GL": 18, "GT": 28,
    "IL": 23, "IQ": 23, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MU": 30, "PK": 24, "PS": 29, "QA": 29, "RS": 22, "SA": 24, "TN": 24, "UA": 29, "VG": 24, "XK": 20,
}
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "card_short": 0.4}
_CARD = frozenset(("card", "cards", "visa", "credit", "amex", "karte", "kreditkarte", "tarjeta", "carte"))
_FOR = {
    "email": frozenset(("mail", "email", "correo", "courriel", "contact", "kontakt")),
    "ip": frozenset(("ip", "server", "host", "address")),
    "card": _CARD,
    "phone": frozenset(("phone", "tel", "call", "mobile", "telefon", "teléfono", "téléphone")),
    "iban": frozenset(("iban", "bank", "konto", "cuenta", "compte", "account")),
    "card_short": _CARD,
}
_AGAINST = frozenset(("version", "isbn", "order", "serial", "invoice", "sku", "id"))
#: What words nearby add and take: an account number beside "serial" falls below ``KEEP``, unless "bank" is there too.
RAISED, LOWERED = 0.2, 0.4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run left of an @, found from the @ so that long runs cost no retries."""
    out, free, at = [], 0, text.find("@")
    before = 0
    while at >= 0:
        low = max(free, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        before = at + 1
        at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Fours of the parts of each maximal dotted run, from the left."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _near(text: str, start: int, end: int) -> set[str]:
    """The whole words within ``NEAR`` code points of a span."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    while 0 < low < start and text[low - 1].isalnum():  # a word cut by the window's edge is none
        low += 1
    while end < high < len(text) and text[high].isalnum():
        high -= 1
    return set(_WORDS.findall(text[low:start].lower())) | set(_WORDS.findall(text[end:high].lower()))


def score(kind: str, text: str, start: int, end: int) -> float:
    """Confidence of a confirmed span: the kind's own, more for one set of words nearby and less for another."""
    near = _near(text, start, end)
    return round(_START[kind] + RAISED * bool(near & _FOR[kind]) - LOWERED * bool(near & _AGAINST), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by kind as listed, then start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = _emails(text)
    if _DIGIT.search(text):
        spans["ip"] = _ips(text)
        for m in _DIGITS.finditer(text):
            n = _digits_of(m.group()) if m.end() - m.start() >= 13 else ""
            if 13 <= len(n) <= 19 and luhn(n):
                spans["card" if len(n) >= 16 else "card_short"].append(m.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits_of(m.group())) <= 15]
        for m in _IBAN.finditer(text):
            size = _IBAN_LENGTH.get(m.group()[:2], 0)
            taken = re.match(rf"(?:\x20?[A-Z0-9]){{{size}}}(?![A-Za-z0-9])", m.group() + text[m.end() : m.end() + 1]) if size else None
            if taken and mod97(taken.group().replace(" ", "")):
                spans["iban"].append((m.start(), m.start() + taken.end()))
    out = []
    for kind in KINDS:
        for a, b in spans[kind]:
            s = score(kind, text, a, b)
            if kind in BASE or s >= KEEP:
                out.append((kind, a, b, s))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,score>>) for each document, in one pass and without a shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "score")

    def make() -> Callable:
        return lambda texts: [pa.array([[dict(zip(names, s, strict=True)) for s in find(t)] for t in texts], kind)]

    return map_texts(
        texts_of(docs, id_col, text_col), make, "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with each span replaced by its kind in brackets, all columns kept.

    Overlapping spans become one replacement named after the first of them.  The new text is
    searched again until nothing is found, so no span is made by its neighbours joining.
    """
    columns = docs.columns

    def clean(text: str) -> str | None:
        spans, new = find(text), None
        while spans:
            parts, last = [], 0
            for k, a, b, _ in sorted(spans, key=lambda s: (s[1], s[2])):
                if a >= last:
                    parts += [text[last:a], f"[{k.upper()}]"]
                last = max(last, b)
            text = new = "".join(parts) + text[last:]
            spans = find(text)
        return new

    text, new = free_name(docs, "as_text"), free_name(docs, "new")
    df = docs.withColumn(text, F.col(text_col).cast("string"))
    df = map_texts(df, lambda: lambda texts: [pa.array([clean(t) for t in texts], pa.string())], f"{new} string", drop=(text,), text=text)
    return df.withColumn(text_col, F.coalesce(new, text_col)).select(*columns)


def op6(docs: DataFrame) -> DataFrame:
    """The contract's digest of the spans: counts by base kind, a hash of the base spans, all spans."""

    def make() -> Callable:
        def helper(texts: list[str]) -> list:
            found = [find(t) for t in texts]
            base = [[s for s in f if s[0] in BASE] for f in found]
            return [
                *(pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE),
                pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base]),
                pa.array([joined(f) for f in found], pa.string()),
            ]

        return helper

    return map_texts(
        texts_of(docs, "doc_id", "text"),
        make,
        "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )
