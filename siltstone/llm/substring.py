"""Substring dedup by seed and extend: winnowed anchors, extension both ways, maximal repeats over a length.

Of every ``WINDOW - SEED + 1`` neighbouring seeds (hashes of SEED words) the least
is an anchor, so two equal windows of WINDOW words have equal anchors at equal
places. Anchors that occur once are dropped; from the others, every window that
an anchor is the least seed of is the extension of that anchor, left and right, to
the full length, and windows that meet again elsewhere are repeats. Neighbouring
repeats join to maximal ones. Comparing extensions by hash of the window in place of
pairwise keeps the work in proportion to the occurrences, however often one occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernel as K
from siltstone.llm.common import aside, discard, maybe_in, membership, settle, ship, text_key

#: Words of a repeat at least, and of a seed.
WINDOW, SEED = 35, 12
_PLACE = 28


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the width values from each place on, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def extensions(words: K.Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window start, its anchor's place, seed hashes by place, word hashes) of all windows within a text."""
    hashes = words.hashes()
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U), hashes
    seeds = K.grams(hashes, seed)
    # High bits of the hash, then the place counted backwards: of equal seeds the rightmost is least.
    ranked = (seeds & ~K.U((1 << _PLACE) - 1)) | (K.U((1 << _PLACE) - 1) - np.arange(len(seeds), dtype=K.U))
    anchor = (K.U((1 << _PLACE) - 1) - (_least(ranked, window - seed + 1) & K.U((1 << _PLACE) - 1))).astype(np.int64)
    doc = words.doc
    start = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :])
    return start, anchor[start], seeds, hashes


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list of values for each of n texts; doc says which, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owner = [], []
        for i, _, data, offsets in K.slices(batch.column(2)):
            words = K.find_words(data, offsets, K.NON_SPACE)
            _, anchor, seeds, _ = extensions(words)
            place = np.unique(anchor)
            doc = words.doc[place]
            # Twice at most from a text: more of the same says no more.
            order = np.lexsort((seeds[place], doc))
            h, d = seeds[place][order], doc[order]
            third = np.zeros(len(h), bool)
            third[2:] = (h[2:] == h[:-2]) & (d[2:] == d[:-2])
            found.append(h[~third].view(np.int64))
            owner.append(d[~third] + i)
        lists = _lists(np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64), batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k1", "k2", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k1, k2, text, anchors that occur again): windows around those anchors."""
    for batch in batches:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        again = batch.column(3)
        flat, edge = again.flatten().to_numpy(zero_copy_only=False).view(K.U), np.concatenate(([0], np.cumsum(again.value_lengths().to_numpy(zero_copy_only=False))))
        for i, j, data, offsets in K.slices(batch.column(2)):
            words = K.find_words(data, offsets, K.NON_SPACE)
            start, anchor, seeds, hashes = extensions(words)
            doc = words.doc
            known = np.zeros(len(start), bool)
            bounds = np.searchsorted(doc[start], np.arange(j - i + 1)) if len(start) else np.zeros(j - i + 1, np.int64)
            for d in range(j - i):
                a, b = bounds[d], bounds[d + 1]
                if b > a:
                    known[a:b] = np.isin(seeds[anchor[a:b]], flat[edge[i + d] : edge[i + d + 1]])
            start = start[known]
            whole = K.grams(hashes, WINDOW)
            second = K.grams(K.mix(hashes ^ K.U(0xA5A5A5A5)), WINDOW)
            parts[0].append(start - words.bounds[doc[start]])
            parts[1].append(whole[start].view(np.int64))
            parts[2].append((second[start] >> K.U(33)).astype(np.int64))
            parts[3].append(doc[start] + i)
        at, one, two, owner = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        edges = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(v, t)) for v, t in ((at, pa.int32()), (one, pa.int64()), (two, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["k1", "k2", "starts", "w1", "w2"])


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, copies, starts): texts of WINDOW words or more with repeated windows.

    ``copies`` over 1 says that the whole text occurs again, so all its windows do;
    ``starts`` are the first words of windows that occur again elsewhere, here or in
    another text. A text is known by 128 bits (see ``text_key``).
    """
    spark = ship(docs.sparkSession)
    keyed = docs.filter(F.col(text).isNotNull()).select(*text_key(text), F.col(text).alias("text"))
    lists = T.ArrayType(T.LongType())
    key = T.StructType().add("k1", "long").add("k2", "long")
    seeded = keyed.mapInArrow(_anchors, T.StructType([*key.fields, T.StructField("anchors", lists)])).filter(F.size("anchors") > 0)
    texts = settle(seeded.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("anchors").alias("anchors")), "seeds", release=True)

    seeds = texts.select("k1", "k2", F.explode("anchors").alias("h"))
    again = settle(seeds.groupBy("h").count().filter("count > 1").select("h"), "seeds-again", release=True, few=True)
    hits = maybe_in(seeds, "h", membership(again, "h")).filter("_maybe").drop("_maybe").join(again, "h", "left_semi")
    known = settle(hits.groupBy("k1", "k2").agg(F.collect_set("h").alias("again")), "seeded-texts", release=True, few=True)

    bodies = maybe_in(keyed, "k1", membership(known, "k1")).filter("_maybe").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    schema = T.StructType([*key.fields, T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("w1", lists), T.StructField("w2", T.ArrayType(T.IntegerType()))])
    extended = bodies.join(known, ["k1", "k2"]).select("k1", "k2", "text", "again").mapInArrow(_windows, schema).filter(F.size("starts") > 0)
    # Written with short ids, which stand for the texts from here on.
    extended = settle(extended.withColumn("id", F.monotonically_increasing_id()), "windows", release=True)
    each = extended.select("id", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select("id", "w.starts", "w.w1", "w.w2")
    twice = each.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    found = each.join(twice, ["w1", "w2"], "left_semi").groupBy("id").agg(F.collect_list("starts").alias("starts"))
    found = settle(found, "repeated-windows", release=True, few=True)
    starts = found.join(extended.select("id", "k1", "k2"), "id").select("k1", "k2", "starts")
    copied = texts.filter("copies > 1").select("k1", "k2", "copies")
    both = copied.join(starts, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("copies", F.lit(1)).alias("copies"), "starts")
    out = settle(both, "repeats", release=True, few=True)
    discard(texts, again, known, extended, found)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", *, drop_text: bool = False) -> DataFrame:
    """Add n_words, n_removed, kept_sha256 and, unless ``drop_text``, kept_text (kept words joined by one space).

    Every word in a window of WINDOW words whose words also start anywhere else is
    removed, in all its occurrences. Rows with equal texts are copies of each other,
    also with equal ids; a null text has no words. Texts are read whole, one slice of
    them at a time; an empty table gives an empty one. Columns of the added names are
    replaced, any other keeps its name and values.
    """
    ship(docs.sparkSession)
    found = repeats(docs, text)
    names = ("n_words", "n_removed", "kept_sha256", "kept_text")
    rest, back = aside(docs.select(*[c for c in docs.columns if c not in names]), "_k1", "_k2", "_copies", "_starts", "_maybe", "_m_at", "_m_slot", "_m_bits")
    kept = [c for c in rest.columns if c != text or not drop_text]
    added = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if not drop_text:
        added = added.add("kept_text", "string")
    width = len(rest.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in added]
            copies = batch.column(width).to_pylist()
            starts = batch.column(width + 1)
            for i, j, data, offsets in K.slices(batch.column(batch.schema.get_field_index(text))):
                words = K.find_words(data, offsets, K.NON_SPACE)
                for d in range(j - i):
                    a, b = int(words.bounds[d]), int(words.bounds[d + 1])
                    gone = np.zeros(b - a, bool)
                    if (copies[i + d] or 0) > 1 and b - a >= WINDOW:
                        gone[:] = True
                    elif starts[i + d].is_valid:
                        gone = K.covered(starts[i + d].values.to_numpy(), WINDOW, b - a)
                    left = b" ".join(words.text(k) for k in (a + np.flatnonzero(~gone)).tolist())
                    row = (b - a, int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if not drop_text else None)
                    for k in range(len(added)):
                        out[k].append(row[k])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *map(pa.array, out, kinds)], [*kept, *added.names])

    schema = T.StructType([*(rest.schema[c] for c in kept), *added.fields])
    keyed = maybe_in(rest.withColumns(dict(zip(("_k1", "_k2"), text_key(text), strict=True))), "_k1", membership(found, "k1"))
    touched = keyed.filter("_maybe").drop("_maybe").join(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("copies").alias("_copies"), F.col("starts").alias("_starts")), ["_k1", "_k2"], "left")
    clean = keyed.filter("not _maybe").select(*rest.columns, F.lit(None).cast("long").alias("_copies"), F.lit(None).cast("array<int>").alias("_starts"))
    return touched.select(*rest.columns, "_copies", "_starts").unionByName(clean).mapInArrow(cut, schema).withColumnsRenamed(back)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
p AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM g JOIN again USING (g)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN p USING (r)
LEFT JOIN (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT d.r, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS i FROM d JOIN p USING (r)) x
           WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS q FROM p) y WHERE y.r = x.r AND y.q = x.i) GROUP BY r) k USING (r)
"""
