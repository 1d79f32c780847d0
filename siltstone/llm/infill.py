"""Fill-in-the-middle over ropes: texts are trees, cut at two unit ranks and put together anew.

A leaf holds some units (a word with the white space before it, or white space at
the end) and caches their number and that of its code points; an inner node the sums
of its sides. Cutting at a rank and joining touch a path of the tree only, and share
all other leaves. The inverse cuts the tree of an output at the code points of its
sentinels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.common import ship

#: Sentinels before prefix, suffix and middle; of texts in percent, those rearranged, and of these those with the suffix first; seed of the draws.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Units of a leaf.
LEAF = 256

_UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
_LEAF = re.compile(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,%d}+|[\x20\x09-\x0D]++" % LEAF)


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or a node of two sides; the empty text is None in place of a rope."""

    units: int
    chars: int
    height: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += (node.right, node.left)


def leaf(text: str, units: int) -> Rope | None:
    return Rope(units, len(text), 0, text) if text else None


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def _even(a: Rope, b: Rope) -> Rope:
    """A node of sides whose heights differ by two at most, turned so that they differ by one."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """Both in a row, in steps as many as their heights differ by."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _even(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _even(concat(a, b.left), b.right)
    return _node(a, b)


def build(text: str) -> Rope | None:
    """The rope of a text, balanced."""
    row = []
    for m in _LEAF.finditer(text):
        row.append(Rope(LEAF, len(m.group()), 0, m.group()))
    if row:
        # All leaves are full but the last two, of which one may be white space.
        for k in (-1, -2)[: len(row)]:
            row[k] = leaf(row[k].text, len(_UNIT.findall(row[k].text)))
    while len(row) > 1:
        row = [_node(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else None


def _units(text: str) -> int:
    return len(_UNIT.findall(text))


def cut(rope: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` units (or ``by`` chars: code points), and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.left is not None:
        here = getattr(rope.left, by)
        if rank < here:
            a, b = cut(rope.left, rank, by)
            return a, concat(b, rope.right)
        a, b = cut(rope.right, rank - here, by)
        return concat(rope.left, a), b
    if by == "chars":
        head, tail = rope.text[:rank], rope.text[rank:]
        return leaf(head, _units(head)), leaf(tail, _units(tail))
    at = next(islice(_UNIT.finditer(rope.text), rank - 1, None)).end()
    return leaf(rope.text[:at], rank), leaf(rope.text[at:], rope.units - rank)


def flat(rope: Rope | None) -> str:
    return "".join(rope.leaves()) if rope else ""


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key: str, *, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of prefix and of middle) of a text; form is plain, psm or spm."""
    rope = build(text)
    n = rope.units if rope else 0
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return text, "plain", n, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, tail = cut(rope, second)
    prefix, middle = cut(head, first)
    p, s, m = (leaf(x, 0) for x in (PREFIX, SUFFIX, MIDDLE))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    out = None
    for piece in (s, tail, p, prefix, m, middle) if form == "spm" else (p, prefix, s, tail, m, middle):
        out = concat(out, piece)
    return flat(out), form, n, prefix.chars if prefix else 0, middle.chars if middle else 0


def restore(output: str, form: str) -> str:
    """The text of an output: its tree cut at the sentinels, the sides put back in order.

    A sentinel starts with a sign that ends none, so none can arise where pieces meet.
    """
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, pieces, last = build(output), {}, None
    at = 0
    for sentinel in order:
        found = output.index(sentinel, at)
        before, rest = cut(rest, found - at, "chars")
        _, rest = cut(rest, len(sentinel), "chars")
        if last:
            pieces[last] = before
        last, at = sentinel, found + len(sentinel)
    pieces[last] = rest
    return flat(concat(concat(pieces[PREFIX], pieces[MIDDLE]), pieces[SUFFIX]))


COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def rearrange(docs: DataFrame, text: str = "text", key: str = "doc_id", *, drop_text: bool = False, digests: bool = False, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output; one scan, no shuffle.

    ``digests`` gives output_sha256 and restored_sha256 in place of output, the
    second of what ``restore`` makes of the output. A null text counts as empty, an
    empty one is plain; a null key draws as an empty one. Texts are handled whole,
    one at a time. Other columns and repeated rows stay (these alike), an empty table
    gives an empty one, and columns of the added names are replaced; ``text`` and ``key``
    may not be among them. ``drop_text`` leaves the text out.
    """
    ship(docs.sparkSession)
    added = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long")
    for c in ("output_sha256", "restored_sha256") if digests else ("output",):
        added = added.add(c, "string")
    if {text, key} & set(added.names):
        raise ValueError("text and key are named like added columns")
    rest = [c for c in docs.columns if c not in added.names]
    kept = [c for c in rest if c != text or not drop_text]
    schema = T.StructType([*docs.select(*kept).schema.fields, *added.fields])
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            rows = []
            for body, name in zip(column(text), column(key), strict=True):
                body, name = body.as_py() or "", name.as_py()
                output, form, n, prefix, middle = transform(body, "" if name is None else str(name), rate=rate, suffix_first=suffix_first, seed=seed)
                if digests:
                    again = restore(output, form)
                    rows.append((n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest()))
                else:
                    rows.append((n, form, prefix, middle, output))
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*map(column, kept), *new], [*kept, *added.names])

    return docs.select(*rest).mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
g AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM s
"""
