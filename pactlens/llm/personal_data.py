"""Personal data in texts (operator 2).

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for bank
account numbers, ranges and lengths for the rest), and words close by move the score of a
span up or down.  The base kinds of the contract stay whatever their score; the kinds that
the method adds must reach the threshold.

Every pattern is tried from an anchor (an ``@``, a digit, a ``+``), so the cost is linear
even in texts that are one long run of letters or digits.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap; other
columns pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Base kinds in the order of the contract, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "tax")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ ]?[A-Z0-9])")
IBAN_REST = re.compile(r"(?:[ ]?[A-Z0-9]){1,30}+")
TAX = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
# Characters of the account numbers of a country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
# Words near a span that speak for a kind, and words that speak against it.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|adresse)", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment|karte|carte|tarjeta)", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tél|llame)", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)", re.I),
    "tax": re.compile(r"\b(?:ssn|social security|tax|taxpayer)", re.I),
}
AGAINST = re.compile(r"\b(?:example|sample|version|order|invoice|isbn|serial|part)\b", re.I)
#: Score before context; what a word for or against the span adds; what added kinds must reach.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "tax": 0.3}
GAIN, LOSS, NEAR, THRESHOLD = 0.3, 0.2, 48, 0.55

SPANS = "array<struct<kind:string,`start`:bigint,`end`:bigint,score:double>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        # What lies behind this sign cannot start an earlier address: the sign is no local part.
        free = match.end() if match else at + 1
        if match:
            yield start, free
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in DIGITS.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in run.group()) <= 15:
            yield run.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers; words and codes behind one do not belong to it.

    A country of the list fixes the length; of others, the longest run of 15 characters or more
    that ends before something else than a letter or digit and holds mod 97 is taken.
    """
    free = 0
    for head in IBAN.finditer(text):
        rest = IBAN_REST.match(text, head.end()) if head.start() >= free else None
        if not rest:
            continue
        length = IBAN_LENGTHS.get(text[head.start():head.start() + 2])
        account, ends = head.group(), []
        for at in range(rest.start(), rest.end()):
            account += text[at].strip()
            whole = text[at] != " " and not text[at + 1:at + 2].isalnum()
            if whole and (len(account) == length if length else len(account) >= 15):
                ends.append((at + 1, account))
        for end, account in reversed(ends):
            if mod97(account):
                free = end
                yield head.start(), end
                break


def tax_numbers(text: str) -> Iterator[tuple[int, int]]:
    for run in TAX.finditer(text):
        area, group, serial = run.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield run.span()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans of a text, in the order of kinds and starts."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if any(d in text for d in "0123456789"):
        if "." in text:
            found += [("ip", *s) for s in addresses(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
        found += [("iban", *s) for s in accounts(text)]
        if "-" in text:
            found += [("tax", *s) for s in tax_numbers(text)]
    out = []
    for kind, start, end in found:
        near = text[max(0, start - NEAR):start] + "\n" + text[end:end + NEAR // 2]
        score = BASE_SCORE[kind] + GAIN * bool(FOR[kind].search(near)) - LOSS * bool(AGAINST.search(near))
        if kind in KINDS[:4] or score >= THRESHOLD:
            out.append((kind, start, end, min(1.0, max(0.0, score))))
    return out


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>>; positions in code points, ends exclusive."""

    @F.pandas_udf(SPANS)
    def proposed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in texts], dtype=object)

    return proposed(F.coalesce(text, F.lit("")))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans as its last column (``spans``, or longer if that is taken)."""
    return docs.withColumn(fresh(docs, "spans"), spans(F.col(text_col)))


def masked(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[KIND]``; overlaps take the first."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            parts, at = [], 0
            for kind, start, end, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
                if start >= at:
                    parts += [text[at:start], f"[{kind.upper()}]"]
                    at = end
            return "".join([*parts, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, mask(F.col(text_col)))
