"""Benchmark decontamination: a broadcast hash set of test n-grams, verified hits, spans or documents removed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernel as K
from siltstone.llm.common import aside, discard, maybe_in, membership, settle, ship, text_key

#: Words of a window, and bytes of benchmark text in one broadcast; more text goes in further blocks, one at a time.
WINDOW, BLOCK_BYTES = 10, 4 << 20
_BITS = 20


class Index:
    """The windows of some benchmark items by length: sorted hashes, texts and items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = WINDOW):
        owners: dict[tuple[int, bytes], set[str]] = defaultdict(set)
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = K.find_words(raw, np.array([0, len(raw)]), K.ALNUM, K.LOWER)
            found = [words.text(i) for i in range(len(words))]
            size = min(n, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                owners[size, b" ".join(found[i : i + size])].add(item)
        self.by: dict[int, tuple] = {}
        for size in sorted({k for k, _ in owners}):
            windows = [w for k, w in owners if k == size]
            raw = np.frombuffer(b"\n".join(windows), np.uint8)
            words = K.find_words(raw, np.array([0, len(raw)]), K.ALNUM)
            hashes = K.grams(words.hashes(), size)[::size]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes & K.U((1 << _BITS) - 1)] = True
            self.by[size] = (hashes[order], [windows[i] for i in order], [sorted(owners[size, windows[i]]) for i in order], seen)

    def hits(self, words: K.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are in an occurrence of a window, and the items found in each text."""
        cover, items = np.zeros(len(words), bool), defaultdict(set)
        if not len(words):
            return cover, items
        hashes, doc = words.hashes(), words.doc
        for size, (known, windows, owners, seen) in self.by.items():
            g = K.grams(hashes, size)
            maybe = np.flatnonzero(seen[g & K.U((1 << _BITS) - 1)])
            maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
            at = np.searchsorted(known, g[maybe])
            real = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == g[maybe])
            for i, k in zip(maybe[real].tolist(), at[real].tolist(), strict=True):
                here = b" ".join(words.text(j) for j in range(i, i + size))
                while k < len(known) and known[k] == g[i]:
                    if windows[k] == here:
                        cover[i : i + size] = True
                        items[int(doc[i])].update(owners[k])
                    k += 1
        return cover, items


def _parts(benchmark: DataFrame, text: str, item: str) -> tuple[DataFrame, int]:
    """(item, text) rows, and in how many parts of about BLOCK_BYTES they go."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, 1 + size // BLOCK_BYTES


def _index(rows: DataFrame, parts: int, k: int, n: int) -> Index:
    """The index of one part, which alone comes to the driver."""
    part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
    return Index([tuple(r) for r in part.toLocalIterator()], n)


def _in_blocks(docs: DataFrame, rows: DataFrame, parts: int, n: int, text: str) -> DataFrame:
    """(k1, k2, items, covers) of the different texts with hits: a pass for each part, whose index is dropped before the next."""
    spark = docs.sparkSession
    keyed = docs.filter(F.col(text).isNotNull()).select(*text_key(text), F.col(text).alias("text"))
    schema = T.StructType().add("k1", "long").add("k2", "long").add("items", T.ArrayType(T.StringType())).add("cover", "binary")
    done = []
    for k in range(parts):
        index = spark.sparkContext.broadcast(_index(rows, parts, k, n))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, items, cover = [], [], []
                for i, j, data, offsets in K.slices(batch.column(2)):
                    words = K.find_words(data, offsets, K.ALNUM, K.LOWER)
                    hit, own = index.value.hits(words)
                    for d in sorted(own):
                        at.append(i + d)
                        items.append(sorted(own[d]))
                        cover.append(np.packbits(hit[words.bounds[d] : words.bounds[d + 1]]).tobytes())
                keys = batch.select([0, 1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(items, pa.list_(pa.string())), pa.array(cover, pa.binary())], schema.names)

        done.append(settle(keyed.mapInArrow(run, schema).dropDuplicates(["k1", "k2"]), "hits"))
        index.destroy()
    every = spark.read.schema(schema).parquet(*(t._scratch for t in done))
    out = settle(every.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("cover").alias("covers")), "hit-texts")
    discard(*done)
    return out


_ADDED = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("cover", "binary")
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add n_words, n_hit, items (sorted ids as strings) and cover (bits of the hit words; empty if none).

    A benchmark of up to BLOCK_BYTES is one broadcast and one scan without a
    shuffle. A larger one goes in blocks, of which one is alive at a time: each
    writes the hits of the texts it is found in, and these are added up and joined
    to the rows at the end. Words are folded to lower case (A-Z) and made of digits,
    letters a-z and everything beyond ASCII. A null text has no words, an empty table
    gives none, texts of any length are scanned whole; items without words have no
    windows; a null item id counts as "null", equal ids as one item. Repeated rows
    stay, and columns of the added names are replaced. ``keep_text=False`` leaves the
    text out.
    """
    spark = ship(docs.sparkSession)
    rest = docs.select(*[c for c in docs.columns if c not in _ADDED.names])
    names = [c for c in rest.columns if keep_text or c != text]
    rows, parts = _parts(benchmark, item_text, item)
    own = ("_k1", "_k2", "_maybe", "_items", "_covers")
    if parts == 1:
        given, index = rest, spark.sparkContext.broadcast(_index(rows, 1, 0, n))
    else:
        found, index = _in_blocks(rest, rows, parts, n, text), None
        moved, back = aside(rest, *own)
        keyed = maybe_in(moved.withColumns(dict(zip(own, text_key(text), strict=False))), "_k1", membership(found, "k1"))
        hits = found.toDF("_k1", "_k2", "_items", "_covers")
        touched = keyed.filter("_maybe").join(hits, ["_k1", "_k2"], "left").select(*moved.columns, "_items", "_covers")
        clean = keyed.filter("not _maybe").select(*moved.columns, *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in own[3:]))
        given = touched.unionByName(clean).toDF(*(back.get(c, c) for c in moved.columns), "items", "covers")
    columns, width = rest.columns, len(rest.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            known = [batch.column(width + k).to_pylist() for k in (0, 1)] if index is None else None
            for i, j, data, offsets in K.slices(batch.column(batch.schema.get_field_index(text))):
                words = K.find_words(data, offsets, K.ALNUM, K.LOWER)
                hit, items = index.value.hits(words) if index else (None, {})
                for d in range(j - i):
                    if index:
                        mine, own_items = hit[words.bounds[d] : words.bounds[d + 1]], items.get(d, ())
                    else:
                        mine, own_items = np.zeros(words.count[d], bool), known[0][i + d] or ()
                        for cover in known[1][i + d] or ():
                            mine |= unpacked(cover, len(mine))
                    count = int(mine.sum())
                    for k, v in enumerate((len(mine), count, sorted(own_items), np.packbits(mine).tobytes() if count else b"")):
                        found[k].append(v)
            arrays = [batch.column(k) for k, c in enumerate(columns) if c in names]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, found, _ARROW)], [*names, *_ADDED.names])

    return given.mapInArrow(run, T.StructType([*(rest.schema[c] for c in names), *_ADDED.fields]))


def unpacked(bits: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)


def without(text: str, cover: bytes) -> str:
    """``text`` without its stretches of hit words, from the first byte of such a stretch to its last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = K.find_words(raw, np.array([0, len(raw)]), K.ALNUM, K.LOWER)
    run = np.diff(np.concatenate(([0], unpacked(cover, len(words)).astype(np.int8), [0])))
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[words.start[run[:-1] == 1]] += 1
    edge[words.end[run[1:] == -1]] -= 1
    return raw[np.cumsum(edge[:-1]) == 0].tobytes().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, remove: str = "documents", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (remove="spans") with the hit stretches cut from their texts.

    All columns keep their values, also those named like the ones that ``scan``
    adds. Rows with null or empty texts stay, and so do repeated rows.
    """
    moved, back = aside(docs, *_ADDED.names)
    out = scan(moved, benchmark, n, text=moved.columns[docs.columns.index(text)], item=item, item_text=item_text)
    if remove == "documents":
        return out.filter("n_hit = 0").select(*moved.columns).withColumnsRenamed(back)
    text = moved.columns[docs.columns.index(text)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            cover = batch.column(batch.schema.get_field_index("cover")).to_pylist()
            clean = [without(t, c) if c else t for t, c in zip(batch.column(at).to_pylist(), cover, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return out.mapInArrow(cut, out.schema).select(*moved.columns).withColumnsRenamed(back)


#: The same in SQL: windows of items against windows of documents, word by word.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
h AS (SELECT dg.r, dg.i, dg.n, ig.item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
