"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import ship

#: Kinds in their order. The first four are always kept; the others need a score of THRESHOLD.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "secret")
KINDS = BASE + EXTRA
THRESHOLD = 0.5
#: Score of a proposed span, before checksum (+0.3 or drop) and context words (+0.25).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "secret": 0.4}
#: Code points before and after a span in which context words count.
NEAR = 48
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "tax id"),
    "secret": ("token", "secret", "password", "api", "key"),
}

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]), False
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

# A span starts at the first digit of a run, so a run is tried once, and possessive
# repeats never step back: each pattern reads a text in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}((?: ?[A-Z0-9]){11,30}+))")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOWER_IBAN = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}[a-z0-9]{11,30}+(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])([A-Za-z0-9_+/-]{16,}+)={0,2}")
# Forms of keys that say by themselves what they are.
_KEY = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of account numbers: country and check digits to the end, letters as 10 to 35."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest stretch from each start that ends with a word and passes the check; at most 20 are tried a start."""
    last = 0
    for m in _IBAN.finditer(text):
        if m.start() < last:
            continue
        end, n = m.end(1), sum(c != " " for c in m.group(1)) + 4
        while n >= 15:
            if text[end - 1] != " ":
                if not (end < len(text) and text[end].isascii() and text[end].isalnum()) and mod97(text[m.start() : end]):
                    last = end
                    yield m.start(), end
                    break
                n -= 1
            end -= 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        else:
            # The run before this sign cannot be a local part again.
            last = at + 1
        at = text.find("@", max(last, at + 1))


def _secret(run: str, padded: int) -> tuple[int, float]:
    """Length and score of a run of 16 signs or more that may be a secret, 0 for none.

    Known keys need no context. From 32 signs on a digit is enough, with ``/`` or ``+`` also letters of both cases, as
    paths have few; shorter runs are letters and digits alone, three or more of each.
    """
    size = len(run)
    if _KEY.fullmatch(run):
        return size, PRIOR["secret"] + 0.2
    count = sum("0" <= c <= "9" for c in run)
    if size < 32:
        letters = sum(c.isalpha() for c in run)
        return size, PRIOR["secret"] - 0.1 if count >= 3 and letters >= 3 and count + letters == size else 0.0
    if "/" in run or "+" in run:
        return padded, PRIOR["secret"] if count and run != run.lower() and run != run.upper() else 0.0
    return size, PRIOR["secret"] if count else 0.0


def _proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score before context) of the spans that pass their checks."""
    for start, end in _emails(text):
        yield "email", start, end, PRIOR["email"]
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield "ip", m.start(), m.end(), PRIOR["ip"]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), PRIOR["card"] + 0.3
    for m in _PHONE.finditer(text):
        if 9 <= len(digits(m.group())) <= 15:
            yield "phone", m.start(), m.end(), PRIOR["phone"]
    for start, end in sorted([*_ibans(text), *(m.span() for m in _LOWER_IBAN.finditer(text) if mod97(m.group()))]):
        yield "iban", start, end, PRIOR["iban"] + 0.3
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end(), PRIOR["ssn"]
    for m in _RUN.finditer(text):
        end, score = _secret(m.group(1), len(m.group()))
        if score:
            yield "secret", m.start(), m.start() + end, score


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All kept spans (kind, start, end in code points, score), by kind and start."""
    out = []
    for kind, start, end, score in _proposed(text or ""):
        near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
        score = min(1.0, round(score + 0.25 * any(w in near for w in CONTEXT[kind]), 3))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


def find(docs: DataFrame, text: str = "text", out: str = "pii", *, drop_text: bool = False) -> DataFrame:
    """Add the array ``out`` of struct(kind, start, end, score); one scan, no shuffle.

    A null or empty text has an empty array, an empty table no rows; texts of any length are read whole,
    each pattern in linear time. Other columns and repeated rows stay
    as they are, and a column named ``out`` is replaced. ``drop_text`` leaves the
    text out of the result.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != out]
    kept = [c for c in rest if c != text or not drop_text]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.as_py())] for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(rows, _SPANS)], [*kept, out])

    return docs.select(*rest).mapInArrow(scan, schema)


def digest(found: Column) -> Column:
    """kind:start:end of each span, by kind and start, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every kept span replaced by its kind in brackets (overlaps: the widest stretch, first kind).

    Null and empty texts, other columns of any name and repeated rows stay as they are; long texts are read whole.
    """

    ship(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            done = []
            for cell in batch.column(at):
                body = cell.as_py()
                if body is not None:
                    parts, last = [], 0
                    for kind, start, end, _ in sorted(spans(body), key=lambda s: (s[1], -s[2])):
                        if end > last:
                            if start >= last:
                                parts += [body[last:start], f"[{kind}]"]
                            last = end
                    body = "".join([*parts, body[last:]])
                done.append(body)
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
