"""Line dedup by content-defined chunks of lines, with native expressions only.

A rolling hash over every two neighbouring lines makes that window a boundary of one
of ``KINDS`` chunkings, by its remainder, so an insertion moves no boundary but those
beside it. A chunk goes from the first line of a boundary window to the last line
of the next one of its kind, so neighbours overlap in a window and every chunk has
two lines or more; a text's ends are boundaries of every kind. Chunks that occur
again anywhere are found by hash, compared byte for byte, and their lines removed
but for the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import aside, discard, maybe_in, membership, settle

#: The rolling hash is (before * BASE + own) % MODULUS over 28-bit line hashes; its remainder by KINDS is the kind of the boundary.
BASE, MODULUS, KINDS = 1000003, 2147483647, 2
#: A chunk's place is start * _SPAN + lines.
_SPAN = 1 << 31


def let(value: Column, use) -> Column:
    """``use(value)`` with value computed once, although used in lambdas."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _spans(ls: Column) -> Column:
    """Array of start * _SPAN + n: the chunks of these lines, in time linear in their number."""
    line_hash = lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")
    rolling = lambda hs, i: (F.get(hs, i - 1) * BASE + F.get(hs, i)) % MODULUS
    ends = lambda hs, kind: F.filter(F.sequence(F.lit(1), F.size(hs) - 1), lambda i: rolling(hs, i) % KINDS == kind)
    start = lambda es, k: F.when(k == 0, F.lit(0)).otherwise(F.get(es, k - 1) - 1)
    stop = lambda hs, es, k: F.when(k == F.size(es), F.size(hs) - 1).otherwise(F.get(es, k))
    place = lambda a, b: a.cast("bigint") * _SPAN + (b - a + 1)
    cut = lambda hs, es: F.transform(F.sequence(F.lit(0), F.size(es)), lambda k: let(start(es, k), lambda a: place(a, stop(hs, es, k))))
    return let(F.transform(ls, line_hash), lambda hs: F.array_distinct(F.concat(*(let(ends(hs, kind), lambda es: cut(hs, es)) for kind in range(KINDS)))))


def chunks(text: Column, bodies: bool) -> Column:
    """Array of struct(start, n, h) and, with ``bodies``, body: the chunks of a text; one of one line has none. h is of the hashes of its lines."""

    def chunk(ls: Column, xs: Column, at: Column) -> Column:
        first, n = F.floor(at / _SPAN).cast("int"), (at % _SPAN).cast("int")
        fields = [first.alias("start"), n.alias("n"), F.xxhash64(F.slice(xs, first + 1, n)).alias("h")]
        return F.struct(*fields, *([F.array_join(F.slice(ls, first + 1, n), "\n").alias("body")] if bodies else []))

    none = F.lit(None).cast(f"array<struct<start:int,n:int,h:bigint{',body:string' if bodies else ''}>>")
    every = lambda ls: let(F.transform(ls, lambda x: F.xxhash64(x)), lambda xs: F.transform(_spans(ls), lambda at: chunk(ls, xs, at)))
    return F.when(F.contains(text, F.lit("\n")), let(lines(text), every)).otherwise(none)


def _kept(text: Column, gone: Column) -> Column:
    """The lines of text outside the stretches gone (start, n), which are in order."""
    end = lambda g, k: F.when(k == 0, F.lit(0)).otherwise(F.get(g, k - 1)["start"] + F.get(g, k - 1)["n"])
    stop = lambda ls, g, k: F.when(k == F.size(g), F.size(ls)).otherwise(F.get(g, k)["start"])
    parts = lambda ls, g: F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: F.slice(ls, end(g, k) + 1, stop(ls, g, k) - end(g, k)))
    return let(lines(text), lambda ls: let(gone, lambda g: F.flatten(parts(ls, g))))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", *, drop_text: bool = False) -> DataFrame:
    """Add n_lines, n_removed and, unless ``drop_text``, kept_text (the kept lines), and kept_sha256.

    First is the occurrence with the least id (nulls last), then text hash and line.
    Rows equal in id and text are one document and keep the same lines; chunks
    of nothing but white space stay. A null text has no lines and its kept text is
    empty; an empty one has one line. Very long texts are handled whole. Columns of
    the added names are replaced, all others keep their values.
    """
    names = ("n_lines", "n_removed", "kept_text", "kept_sha256")
    given = docs.select(*[c for c in docs.columns if c not in names])
    rest, back = aside(given, "_t", "_u", "_id", "_none", "_gone", "_maybe")
    text, key = (rest.columns[given.columns.index(c)] for c in (text, key))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("t"))
    hashes = rest.select(F.explode(chunks(F.col(text), False)["h"]).alias("h"))
    again = settle(hashes.groupBy("h").count().filter("count > 1").select("h"), "chunks-again", release=True, few=True)
    each = rest.filter(F.contains(F.col(text), F.lit("\n"))).select(row.alias("row"), F.explode(chunks(F.col(text), True)).alias("c")).select("row", "c.*")
    some = settle(maybe_in(each, "h", membership(again, "h")).filter("_maybe").drop("_maybe").filter(F.col("body").rlike(r"\S")), "chunks")
    place = F.struct("row", "start")
    # Grouping by bytes tells which hashes have one body only; those are joined without it.
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    whole = first(some, "h", "body").groupBy("h").agg(F.count(F.lit(1)).alias("bodies"), F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"))
    whole = settle(whole, "chunks-first", release=True, few=True)
    stretch = ["row", "start", (F.col("start") + F.col("n")).alias("stop")]
    later = some.select("row", "start", "n", "h").join(whole.filter("bodies = 1 and n_rows > 1").select("h", "first"), "h").filter(place != F.col("first")).select(*stretch)
    if whole.filter("bodies > 1").head(1):
        mixed = some.join(whole.filter("bodies > 1").select("h"), "h", "left_semi")
        later = later.unionByName(mixed.join(first(mixed, "h", "body").drop("n_rows"), ["h", "body"]).filter(place != F.col("first")).select(*stretch))
    # Overlapping stretches of a document become one.
    by_row = Window.partitionBy("row").orderBy("start", "stop")
    opens = F.coalesce(F.col("start") > F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    joined = later.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(by_row))
    parts = joined.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    gone = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("stop") - F.col("start")).alias("n")))).alias("gone"))
    gone = settle(gone.withColumn("t", F.col("row.t")), "chunks-gone", release=True, few=True)
    discard(again, some, whole)

    keyed = maybe_in(rest.withColumn("_t", F.xxhash64(text)), "_t", membership(gone, "t"))
    g = gone.select(F.col("row.none").alias("_none"), F.col("row.id").alias("_id"), F.col("t").alias("_u"), F.col("gone").alias("_gone"))
    touched = keyed.filter("_maybe").join(g, (F.col("_t") == F.col("_u")) & F.col(key).eqNullSafe(F.col("_id")) & F.col(text).isNotNull(), "left")
    empty = F.lit(None).cast("array<struct<start:int,n:int>>")
    rows = touched.select(*rest.columns, "_gone").unionByName(keyed.filter("not _maybe").select(*rest.columns, empty.alias("_gone")))
    n_removed = F.coalesce(F.aggregate("_gone", F.lit(0), lambda s, x: s + x["n"]), F.lit(0)).cast("bigint")
    kept_text = F.when(F.col("_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(_kept(F.col(text), F.col("_gone")), "\n"))
    out = rows.select(
        *[F.col(c).alias(back.get(c, c)) for c in rest.columns if c != text or not drop_text],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text), F.lit("\n")) + 1).cast("bigint").alias("n_lines"),
        n_removed.alias("n_removed"),
        kept_text.alias("kept_text"),
    ).withColumn("kept_sha256", F.sha2("kept_text", 256))
    return out.drop("kept_text") if drop_text else out


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i, ('0x' || substr(md5(ls[i + 1]), 1, 7))::BIGINT AS h FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM d WHERE len(ls) > 1)),
r AS (SELECT doc_id, text, i, (lag(h) OVER (PARTITION BY doc_id, text ORDER BY i) * 1000003 + h) % 2147483647 % 2 AS kind FROM l),
w AS (SELECT doc_id, text, kind, i, coalesce(lag(i) OVER (PARTITION BY doc_id, text, kind ORDER BY i) - 1, 0) AS start FROM r WHERE i > 0),
e AS (SELECT d.doc_id, d.text, k.kind, len(d.ls) - 1 AS i, coalesce(max(w.i) - 1, 0) AS start FROM d CROSS JOIN (SELECT unnest([0, 1]) AS kind) k
      LEFT JOIN w ON w.doc_id IS NOT DISTINCT FROM d.doc_id AND w.text = d.text AND w.kind = k.kind WHERE len(d.ls) > 1 GROUP BY d.doc_id, d.text, d.ls, k.kind),
c AS (SELECT DISTINCT doc_id, text, start, i FROM (SELECT doc_id, text, start, i FROM w UNION ALL SELECT doc_id, text, start, i FROM e)),
b AS (SELECT c.*, array_to_string(string_split(c.text, chr(10))[start + 1 : i + 1], chr(10)) AS body FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, start) > 1 AND regexp_matches(body, '\S') AS gone FROM b),
g AS (SELECT DISTINCT doc_id, text, unnest(range(start, i + 1)) AS i FROM x WHERE gone),
o AS (SELECT d.doc_id, d.text, count(g.i)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY d.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM (SELECT doc_id, text, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d) d
      LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.text = d.text AND g.i = d.i GROUP BY d.doc_id, d.text)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.text IS NOT DISTINCT FROM o.text
"""
