"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words set the score.

Kinds: e-mail addresses, IP addresses (parts up to 255), card numbers (16 to 19 digits, Luhn), phone numbers
(8 to 15 digits), and, beyond these, international bank account numbers (mod 97).  Each kind is searched
leftmost first without overlaps, and a proposed span that fails its check is dropped whole.  The
searches look at each character a bounded number of times, also in very long runs of digits or letters.

The score of a confirmed span starts from how strong the kind's check is and moves with words in the ``NEAR`` characters
before the span.  A base span keeps its place whatever its score, which stands beside it; an added span (account numbers)
counts from ``LEAST_SCORE`` on, so that one called an example is left out unless other words speak for it.

Defined results: a null or empty text has no spans; ids may be null or repeated; offsets count code
points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
NEAR = 40

# What each check is worth by itself, and the words that speak for or against a kind.
START_SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
WORDS_FOR = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
}
WORDS_AGAINST = ("example", "sample", "test", "version", "order", "serial", "isbn", "dummy")
STEP = 0.15
LEAST_SCORE = 0.7

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9](?:[ .-]?[0-9])*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # No local part reaches back over an @, nor into an address found before.
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """IP addresses and cards, inside the runs of digits that they can only lie in."""
    for run in _NUMBERS.finditer(text):
        start, whole = run.start(), run.group()
        if len(whole) < 7:
            continue
        if whole.count(".") >= 3:
            # Groups of digits first: four that only points join are an address.  A match takes whole groups, so none is looked at twice.
            parts: list[re.Match] = []
            for group in _DIGITS.finditer(whole):
                if parts and not (group.start() == parts[-1].end() + 1 and whole[group.start() - 1] == "."):
                    parts = []
                parts.append(group)
                if len(parts) == 4:
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.group().lstrip("0") for g in parts)):
                        yield "ip", start + parts[0].start(), start + group.end()
                    parts = []
        if len(whole) >= 16:
            for found in _CARD.finditer(whole):
                digits = digits_of(found.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    yield "card", start + found.start(), start + found.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(digits_of(found.group())) <= 15:
                yield found.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that no letter or digit touches."""
    free = 0
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        if start < free or start and text[start - 1].isalnum():
            continue
        found = _IBAN.match(text, start)
        if not found:
            continue
        # The longest reading that passes: text in capitals may follow the number.
        ends = [m for m in range(found.end(), start + 14, -1) if text[m - 1] != " " and (m == len(text) or not text[m].isalnum())]
        for end in ends:
            compact = text[start:end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield start, end
                free = end
                break


def score(kind: str, text: str, start: int) -> float:
    near = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
    value = START_SCORES[kind]
    value += STEP * any(w in near for w in WORDS_FOR[kind]) - STEP * any(w in near for w in WORDS_AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Confirmed spans with their scores by kind, in the order of ``KINDS``, then by start; added ones from ``LEAST_SCORE`` on."""
    found = [("email", *s) for s in emails(text)] + list(numbers(text))
    found += [("phone", *s) for s in phones(text)] + [("iban", *s) for s in accounts(text)]
    scored = [(kind, a, b, score(kind, text, a)) for kind, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= LEAST_SCORE]


def spans(text: str) -> list[tuple[str, int, int]]:
    return [s[:3] for s in scored_spans(text)]


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row; spans lie in the order of their kinds, then of their starts."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "score": value} for k, a, b, value in scored_spans(text)]
                    for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    return map_batches(id_and_text(docs, id_col, text_col), run, f"doc_id bigint, spans {SPAN}")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text, and their scores in the same order."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for kind, start, end in sorted(spans(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with spans replaced in the text, and ``n_chars``, where there is one, counted anew."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([t if t is None else redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at), clean.cast(batch.schema.field(at).type))

    out = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.coalesce(F.char_length(f"`{text_col}`").cast(kind), F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(docs.columns)
