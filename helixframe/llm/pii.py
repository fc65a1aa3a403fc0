"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every kind has a pattern, a validator and a score out of 100 for what passes it;
a context word of the kind within 40 characters adds ``CONTEXT``.  Four kinds are the base: every match that
passes its validator counts, whatever stands around it.  The others (account
numbers by mod-97, national and local telephone numbers by context) count from a
score of ``ACCEPTED``, unless they overlap a base span.

Matches of a kind are leftmost and don't overlap; one that its validator drops
isn't tried again in parts.  Each pattern is searched in time that grows with
the text, whatever it holds: a run of characters that can't become a match is
passed over once.  Positions are code points, ends exclusive.

Null and empty texts have no spans.  Repeated rows and ids are documents of their
own, a very long text is searched whole, an empty table gives no rows, and
further columns are ignored.  Documents don't meet: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
#: Scores of what its validator passes, what a context word adds, the least score of an added span, and how far context reaches.
SCORES = {"email": 90, "ip": 70, "card": 80, "phone": 70, "iban": 80, "national_id": 30, "local_phone": 30}
CONTEXT, ACCEPTED, REACH = 30, 50, 40
#: Words that speak for a kind, in four languages.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appelez", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appelez", "llame"),
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
DIALLED = re.compile(r"\+[0-9]([ ().0-9-]++)")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)
NATIONAL = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
LOCAL_PHONE = re.compile(r"\b[0-9]{3}[ -][0-9]{3}-[0-9]{4}\b", re.ASCII)
NEAR = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.ASCII | re.IGNORECASE) for k, words in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of ten."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces, its first four characters moved to the end and letters as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, after = text.find("@"), 0
    while at >= 0:
        before = text[after:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at) if local else None
        after = at + 1
        if found:
            yield at - local, found.end()
            after = found.end()
        at = text.find("@", after)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".") if "." in m[0] else ()
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        after = at + 1
        if m := DIALLED.match(text, at):
            rest = m[1].rstrip(" ().-")
            if len(rest) >= 2:
                after = at + 2 + len(rest)
                if 9 <= 1 + sum(map(rest.count, "0123456789")) <= 15:
                    yield at, after
        at = text.find("+", after)


def accounts(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in IBAN.finditer(text) if mod97(m[0].replace(" ", "")))


def matches(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "national_id": matches(NATIONAL), "local_phone": matches(LOCAL_PHONE)}
HAS_DIGIT = re.compile("[0-9]")


def score(kind: str, text: str, start: int, end: int) -> int:
    """The kind's score, raised by a context word close before or behind the span."""
    near = NEAR[kind].search(text[max(0, start - REACH) : start]) or NEAR[kind].search(text[end : end + REACH])
    return min(100, SCORES[kind] + (CONTEXT if near else 0))


def spans(text: str | None) -> list[dict]:
    """All spans of a text: kind, start, end, score, by start, then kind."""
    if not text:
        return []
    kinds = BASE + ADDED if HAS_DIGIT.search(text) else ("email",)
    found = [(a, k, b) for k in kinds if k in BASE for a, b in FINDERS[k](text)]
    base = sorted((a, b) for a, _, b in found)
    for k in kinds:
        if k in ADDED:
            at = 0  # spans of a kind ascend, so base spans that end before one are passed for good
            for a, b in FINDERS[k](text):
                while at < len(base) and base[at][1] <= a:
                    at += 1
                if not (at < len(base) and base[at][0] < b) and score(k, text, a, b) >= ACCEPTED:
                    found.append((a, k, b))
    rank = {k: i for i, k in enumerate(BASE + ADDED)}
    found.sort(key=lambda x: (x[0], rank[x[1]]))
    return [{"kind": k, "start": a, "end": b, "score": score(k, text, a, b)} for a, k, b in found]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and spans, an array of (kind, start, end, score)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((spans(x.as_py()) for x in batch.column(1)), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "spans"])

    out = own.mapInArrow(work, f"id {own.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:int>>")
    return out.withColumnRenamed("id", id_col)


def listed(column, kinds: tuple[str, ...]):
    """Spans of some kinds as text: kind:start:end, comma-joined."""
    own = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(column, kind: str):
    """How many spans of a kind there are."""
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
