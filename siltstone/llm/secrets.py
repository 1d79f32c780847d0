"""Secrets in texts and in what is encoded in them: a worklist of decoded layers.

The text is the first layer. Each layer is scanned for the three kinds, then its
escapes (URL and Unicode) and its base64 and compressed runs are unwrapped to new
layers, until none is new. A layer knows how its positions lead to those of the
layer it came from, so every span is one of the text. A layer whose content was
seen at the same place before is not opened again, which ends cycles.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import ship

#: Kinds in their order.
KINDS = ("assign", "access", "hex")
#: A packed run that opens to more bytes than this is a span of this kind, and is not read.
OVERSIZED, OPENED = "oversized", 1 << 26

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
_PERCENT = re.compile(r"[0-9A-Fa-f]{2}")
_SLASH = re.compile(r"u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}+={0,2}")
_ROW = re.compile(r"\r?\n([A-Za-z0-9+/_-]++={0,2})")
_LOW = re.compile(r"\\u(d[c-f][0-9a-f]{2})", re.IGNORECASE)
#: Starts of compressed content in base64, and readable bytes, 16 at least.
_STARTS = re.compile(r"H4sI|KLUv")
_READABLE = re.compile(rb"[\t\n\r\x20-\x7E]{16,}+")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
#: Escaped bytes that start like gzip, zlib or zstd.
_PACKED = re.compile(r"(?:%|\\x)1f(?:%|\\x)8b(?:%|\\x)08|(?:(?:%|\\x)78|x)(?:%|\\x)(?:01|5e|9c|da)|(?:(?:%|\\x)28|\()(?:%|\\x)b5(?:(?:%|\\x)2f|/)(?:%|\\x)fd", re.IGNORECASE)
_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[tnr0\\'\"]|[!\"#$&-\[\]-~ ])++")
_PLAIN = {"t": 9, "n": 10, "r": 13, "0": 0}

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("layers", T.StringType())]
    ),
    False,
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))

Place = Callable[[int, int], tuple[int, int]]


@dataclass
class Layer:
    """A decoded text; ``place`` leads a span of it to the document; ``names`` are the unwrappings so far."""

    text: str
    place: Place
    names: tuple[str, ...] = ()


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each kind in one layer, leftmost first; too short matches are passed over whole."""
    for m in _ASSIGN.finditer(text):
        if m.end() - m.start(1) >= 12:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _chain(text: str, at: int) -> tuple[int, int]:
    """(code, end) of the escape at a percent sign or backslash; one that yields such a sign goes on with what follows.

    So ``%252541`` is one character. What is skipped between are shorter forms of the
    same digits, whose secrets lie within those of the layer before.
    """
    code, end = ord(text[at]), at + 1
    while True:
        if code == 0x25 and (m := _PERCENT.match(text, end)):
            code, end = int(m.group(), 16), m.end()
        elif code == 0x5C and (m := _SLASH.match(text, end)):
            code, end = int(next(g for g in m.groups() if g), 16), m.end()
        else:
            return code, end


def unescape(layer: Layer) -> Layer | None:
    """The layer with its URL and Unicode escapes decoded; none if it has no escape."""
    text = layer.text
    m = _ESCAPE.search(text)
    if not m:
        return None
    pieces: list[str] = []
    # Stretches: start in the decoded text, start and end here, and whether each character stands for itself.
    outs, ins, ends, same = [], [], [], []
    out = last = 0

    def put(piece: str, a: int, b: int, plain: bool) -> None:
        nonlocal out
        if piece:
            pieces.append(piece)
            outs.append(out)
            ins.append(a)
            ends.append(b)
            same.append(plain)
            out += len(piece)

    while m:
        a = m.start()
        put(text[last:a], last, a, True)
        code, end = _chain(text, a)
        if code >= 0x80 and text[end - 3] == "%":
            # Bytes of UTF-8 in a row.
            found = bytearray([code])
            while text[end : end + 1] == "%" and (d := _PERCENT.match(text, end + 1)) and int(d.group(), 16) >= 0x80:
                found.append(int(d.group(), 16))
                end = d.end()
            put(found.decode("utf-8", "replace"), a, end, False)
        else:
            if 0xD800 <= code < 0xDC00 and (d := _LOW.match(text, end)):
                code, end = 0x10000 + ((code - 0xD800) << 10) + int(d.group(1), 16) - 0xDC00, d.end()
            put(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", a, end, False)
        last = end
        m = _ESCAPE.search(text, last)
    put(text[last:], last, len(text), True)

    def place(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(outs, start) - 1, bisect_right(outs, end - 1) - 1
        a = ins[i] + (start - outs[i] if same[i] else 0)
        b = ins[j] + (end - outs[j]) if same[j] else ends[j]
        return layer.place(a, b)

    return Layer("".join(pieces), place, (*layer.names, "escape"))


def _opener(raw: bytes):
    """(name, decompressor) by the first bytes, or None."""
    if raw[:3] == b"\x1f\x8b\x08":
        return "gzip", zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] == 0x78 and raw[1] in (0x01, 0x5E, 0x9C, 0xDA):
        return "zlib", zlib.decompressobj(15)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor(max_window_size=OPENED).decompressobj()
    return None


def _opens(head: bytes, content: bool = False) -> bool:
    """Whether bytes may go on to be compressed content; ``content``: whether some comes already."""
    found = _opener(head)
    try:
        return bool(found) and (bool(found[1].decompress(head)) or not content)
    except (zlib.error, zstandard.ZstdError):
        return False


def _inflate(raw: bytes) -> tuple[str, bytes, int] | None:
    """(name, content, bytes used) of compressed bytes, also of a part of such; None if they are none. Raises MemoryError beyond OPENED bytes."""
    found = _opener(raw)
    if not found:
        return None
    name, opener = found
    try:
        if name == "zstd":
            # A few bytes at a time, as this opener has no bound of its own.
            content = bytearray()
            for i in range(0, len(raw), 1024):
                content += opener.decompress(raw[i : i + 1024])
                if opener.eof or len(content) > OPENED:
                    break
            used = min(i + 1024, len(raw)) - len(opener.unused_data)
        else:
            content = opener.decompress(raw, OPENED + 1)
            used = len(raw) - len(opener.unused_data)
    except (zlib.error, zstandard.ZstdError):
        return None
    if len(content) > OPENED:
        raise MemoryError(name)
    return (name, bytes(content), used) if content else None


def _bytes_of(run: str) -> bytes | None:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _printable(raw: bytes) -> str | None:
    try:
        found = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(found) else found


def _base64_place(layer: Layer, content: str, rows: list[tuple[int, int]], skip: int = 0) -> Place:
    """Places of the content of a run in these stretches of a layer, ``skip`` bytes into it."""
    begins = []
    total = 0
    for a, b in rows:
        begins.append(total)
        total += b - a

    def at(i: int) -> int:
        k = bisect_right(begins, i) - 1
        return rows[k][0] + i - begins[k]

    def place(start: int, end: int) -> tuple[int, int]:
        a, b = (start, end) if content.isascii() else (len(content[:start].encode()), len(content[:end].encode()))
        return layer.place(at((skip + a) * 8 // 6), at(((skip + b) * 8 - 1) // 6) + 1)

    return place


def _raw(run: str) -> tuple[bytes, list[int]]:
    """The bytes of a run with escaped bytes among plain ones, and where each starts."""
    out, starts = bytearray(), []
    i = 0
    while i < len(run):
        starts.append(i)
        if run[i] == "%":
            out.append(int(run[i + 1 : i + 3], 16))
            i += 3
        elif run[i] == "\\" and run[i + 1] == "x":
            out.append(int(run[i + 2 : i + 4], 16))
            i += 4
        elif run[i] == "\\":
            out.append(_PLAIN.get(run[i + 1], ord(run[i + 1])))
            i += 2
        else:
            out.append(ord(run[i]))
            i += 1
    return bytes(out), [*starts, i]


def _unpacked(raw: bytes, names: tuple[str, ...], span: tuple[int, int], seen: set) -> Iterator[Layer | tuple[int, int]]:
    """What compressed bytes hold, layer within layer; every place of it is the whole run. The run's span alone if it is too large."""
    while True:
        try:
            found = _inflate(raw)
        except MemoryError:
            yield span
            return
        if not found:
            return
        names, raw = (*names, found[0]), found[1]
        key = ("packed", hashlib.sha256(raw).digest(), span)
        if key in seen:
            return
        seen.add(key)
        yield Layer(raw.decode("utf-8", "replace"), lambda start, end: span, names)


def _escaped(layer: Layer, seen: set) -> Iterator[Layer | tuple[int, int]]:
    """Compressed bytes that stand escaped in a layer."""
    m = _PACKED.search(layer.text)
    while m:
        end = m.end()
        probe = _BYTES.match(layer.text, m.start(), m.start() + 64)
        if probe and _opens(_raw(probe.group())[0]):
            raw, starts = _raw(_BYTES.match(layer.text, m.start()).group())
            try:
                used = (_inflate(raw) or ("", b"", 0))[2]
            except MemoryError:
                used = len(raw)
            if used:
                end = m.start() + starts[used]
                yield from _unpacked(raw[:used], (*layer.names, "escape"), layer.place(m.start(), end), seen)
        m = _PACKED.search(layer.text, end)


def _encoded(layer: Layer, rows: list[tuple[int, int]], seen: set) -> Iterator[Layer | tuple[int, int]]:
    """What a run of base64 holds: text, compressed bytes, or else readable stretches at each of the four alignments."""
    run = "".join(layer.text[a:b] for a, b in rows)
    names = (*layer.names, "base64")
    raw = _bytes_of(run)
    content = None if raw is None else _printable(raw)
    if content is not None:
        yield Layer(content, _base64_place(layer, content, rows), names)
        return
    found = list(_unpacked(raw, names, layer.place(rows[0][0], rows[-1][1]), seen)) if raw else []
    yield from found
    if found or len(rows) > 1:
        return
    a, b = rows[0]
    m = _STARTS.search(run, 1)
    while m:
        end = m.end()
        if _opens(_bytes_of(run[m.start() : m.start() + 1024].rstrip("=")) or b"", True):
            inner = list(_unpacked(_bytes_of(run[m.start() :].rstrip("=")) or b"", names, layer.place(a + m.start(), b), seen))
            yield from inner
            end = len(run) if inner else end
        m = _STARTS.search(run, end)
    for skip in range(4):
        whole = run[skip:].rstrip("=")
        for m in _READABLE.finditer(_bytes_of(whole if len(whole) % 4 != 1 else whole[:-1]) or b""):
            content = m.group().decode()
            yield Layer(content, _base64_place(layer, content, [(a + skip, b)], m.start()), names)


def unwrap(layer: Layer, seen: set) -> Iterator[Layer | tuple[int, int]]:
    """The layers one unwrapping further; a span in place of one that is too large."""
    text = layer.text
    if "%" in text or "\\" in text:
        plain = unescape(layer)
        if plain:
            yield plain
        yield from _escaped(layer, seen)
    joined = 0
    for m in _RUN.finditer(text):
        yield from _encoded(layer, [m.span()], seen)
        if m.start() < joined:
            continue
        # Lines of one width; the last may be shorter, or not belong to them.
        rows, width = [m.span()], m.end() - m.start()
        while rows[-1][1] - rows[-1][0] == width and (n := _ROW.match(text, rows[-1][1])) and n.end(1) - n.start(1) <= width:
            rows.append(n.span(1))
        joined = rows[-1][1]
        for n in (len(rows), len(rows) - 1):
            if n > 1:
                yield from _encoded(layer, rows[:n], seen)


def spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """All (kind, start, end, layers) in code points, by start, kind and end; layers is empty for what stands in the text itself.

    A span that several layers show is listed once, by the first of them. A run that
    opens to over OPENED bytes is a span of kind "oversized".
    """
    if not text:
        return []
    found: dict[tuple[str, int, int], str] = {}
    seen: set = set()
    work = [Layer(text, lambda start, end: (start, end))]
    while work:
        layer = work.pop()
        for kind, start, end in scan(layer.text):
            found.setdefault((kind, *layer.place(start, end)), ">".join(layer.names))
        for new in unwrap(layer, seen):
            if isinstance(new, tuple):
                found.setdefault((OVERSIZED, *new), ">".join(layer.names))
            elif new.text:
                key = (hashlib.sha256(new.text.encode()).digest(), new.place(0, len(new.text)))
                if key not in seen:
                    seen.add(key)
                    work.append(new)
    order = {k: i for i, k in enumerate((*KINDS, OVERSIZED))}
    return [(*span, found[span]) for span in sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))]


def find(docs: DataFrame, text: str = "text", out: str = "secrets", *, drop_text: bool = False) -> DataFrame:
    """Add the array ``out`` of struct(kind, start, end, layers); one scan, no shuffle.

    A null or empty text has an empty array. Texts are read whole, however long; time
    and memory grow with a text and what it unpacks to, which is OPENED bytes a run at
    most. Other columns and repeated rows stay as they are, an empty table gives an
    empty one, and a column named ``out`` is replaced. ``drop_text`` leaves the text
    out of the result.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != out or c == text]
    kept = [c for c in rest if c != out and (c != text or not drop_text)]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in spans(t.as_py())] for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(rows, _SPANS)], [*kept, out])

    return docs.select(*rest).mapInArrow(run, schema)


def digest(found: Column) -> Column:
    """kind:start:end of each span, in the order of the array, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of overlapping spans replaced by ``mask``.

    Null and empty texts, other columns and repeated rows stay as they are; an empty
    table gives an empty one.
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
                    for _, start, end, _ in spans(body):
                        if end > last:
                            if start >= last:
                                parts += [body[last:start], mask]
                            last = end
                    body = "".join([*parts, body[last:]])
                done.append(body)
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
