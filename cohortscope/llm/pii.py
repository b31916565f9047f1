"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Every proposal has a score: a passed checksum (Luhn, mod-97) or range raises it, words on
either side raise or lower it.  Base kinds (email, ip, card, phone) follow fixed patterns and
are always reported, with their scores.  The method adds bank accounts (``iban``), social
security numbers (``ssn``) and phone numbers without a plus sign (``tel``) from ``ACCEPT`` on.

Every pattern needs linear time: runs are possessive and start where a run starts, and
addresses grow from their ``@``.

Defined cases: NULL is an empty text without spans; texts are used whole; repeated rows get
the same spans; an empty table gives an empty one; other columns are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = KINDS[:4]
ACCEPT = 0.6
NEAR = 48                   # code points before and behind a span searched for context words
PROPOSED = {"email": 0.8, "ip": 0.4, "card": 0.2, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "tel": 0.3}
CONFIRMED = {"ip": 0.1, "card": 0.5, "phone": 0.1, "iban": 0.6}     # by checksum or range
RAISED, LOWERED = 0.4, 0.3
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "kreditkarte",
             "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "handy", "anrufen",
              "telefono", "teléfono", "llamar", "téléphone", "appeler"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "virement",
             "cuenta", "transferencia"),
    "ssn": ("ssn", "social", "security", "taxpayer", "identification"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "handy", "anrufen",
            "telefono", "teléfono", "llamar", "téléphone", "appeler"),
}
AGAINST = ("order", "invoice", "isbn", "serial", "version", "part", "bestellung", "rechnung",
           "commande", "facture", "pedido", "factura")
#: Characters of a bank account number, and the countries that use so many (fixed values).
COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SIZES = {country: size for size, named in COUNTRIES.items() for country in named.split()}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of a bank account number: letters count from 10 on."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0                # the local part may not reach into the address before
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Bank accounts that pass mod-97.

    A proposal takes upper-case words and digits behind the account with it.  It ends at the
    country's size, else where it ends; of an unknown country, at the last space that passes.
    The search goes on behind the account, or behind the start of a proposal without one.
    """
    at = 0
    while m := _IBAN.search(text, at):
        whole, at = m.group(), m.start() + 1
        ends = [len(whole)] + [k for k in range(len(whole) - 1, 0, -1) if whole[k] == " "]
        bare = {k: whole[:k].replace(" ", "") for k in ends}
        if size := SIZES.get(whole[:2]):
            ends = [k for k in ends if len(bare[k]) == size] + ends[:1]
        for k in ends:
            if 15 <= len(bare[k]) <= 34 and mod97(bare[k]):
                yield m.start(), m.start() + k
                at = m.start() + k
                break


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind.  All are kept,
    whatever their score."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
                   for part in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return [(a, b, kind, score(kind, text, a, b)) for a, b, kind in out]


def score(kind: str, text: str, start: int, end: int) -> float:
    """Of a span whose checksum, if it has one, has passed: words on either side adjust it."""
    words = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
    words.update(_WORD.findall(text[end:end + NEAR].lower()))
    value = PROPOSED[kind] + CONFIRMED.get(kind, 0.0)
    value += RAISED if words.intersection(CONTEXT[kind]) else 0.0
    return round(max(0.0, min(1.0, value - (LOWERED if words.intersection(AGAINST) else 0.0))), 3)


def added_spans(text: str) -> list[Span]:
    """Spans of the further kinds, with their scores."""
    if not _DIGIT.search(text):
        return []
    out = []
    for kind, found in (("iban", accounts(text)),
                        ("ssn", (m.span() for m in _SSN.finditer(text))),
                        ("tel", (m.span() for m in _TEL.finditer(text)))):
        for a, b in found:
            value = score(kind, text, a, b)
            if value >= ACCEPT:
                out.append((a, b, kind, value))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def replace(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind."""
    out, at = [], 0
    for a, b, kind, _ in in_order(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _find(batches):
    for batch in batches:
        ids, rows = batch.column(0), []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = in_order(base_spans(text))
            spans = in_order(base + added_spans(text))
            kinds = [s[2] for s in base]
            rows.append((*[kinds.count(k) for k in BASE],
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                         ",".join(f"{s[3]:g}" for s in spans)))
        cols = list(zip(*rows)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays(
            [ids] + [pa.array(c, t) for c, t in zip(cols, types)],
            ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores"])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of every document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInArrow(
        _find, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
               "base_sha256 string, spans string, scores string")


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced by its kind; NULL texts stay NULL.

    Where a text changes, its length in ``size`` follows, if there is such a column.
    """
    at = docs.columns.index(text)
    n_at = docs.columns.index(size) if size in docs.columns else None

    def clean(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [replace(t, base_spans(t) + added_spans(t)) if t else t for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if n_at is not None:
                sizes = [n if a == b else len(b) for a, b, n in
                         zip(old, new, cols[n_at].to_pylist())]
                cols[n_at] = pa.array(sizes, batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
