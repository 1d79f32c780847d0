"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments with a table each. A query looks up its segments'
neighbours at growing radii; after radius r in a of the SEGMENTS segments (r - 1 in the
others) every row within SEGMENTS * r + a - 1 bits has been seen, so the search ends
once the k-th verified distance is not above that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import settle, ship

#: Bits of a code and its segments; neighbours; queries in one broadcast; rows that one table indexes, about; sampled rows for first bounds.
BITS, SEGMENTS, K, BLOCK, PART, SAMPLE = 64, 4, 10, 1 << 20, 1 << 14, 4096
WIDTH = BITS // SEGMENTS
_LOW = np.uint64((1 << WIDTH) - 1)
_LANES = 64


@lru_cache(maxsize=WIDTH + 1)
def masks(radius: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)


def codes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, code): bit i says whether element i is above zero. Missing and null elements count as zero; null vectors drop out, and one of more than BITS elements is an error."""
    ship(vectors.sparkSession)
    rows = vectors.filter(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.nan_to_num(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float))
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if (size > BITS).any():
                raise ValueError(f"a vector has {size.max()} elements, a code {BITS}")
            edge = np.cumsum(size) - size
            place = np.arange(len(flat)) - np.repeat(edge, size)
            bits = np.zeros((len(size), BITS), bool)
            bits[np.repeat(np.arange(len(size)), size), place] = flat > 0
            code = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel() if len(size) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.int64())], ["id", "code"])

    return rows.mapInArrow(encode, T.StructType().add("id", "long").add("code", "long"))


class Tables:
    """Rows by the value of each segment."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order, self.edge = [], []
        for j in range(SEGMENTS):
            part = ((code >> np.uint64(j * WIDTH)) & _LOW).astype(np.int64)
            self.order.append(np.argsort(part, kind="stable"))
            self.edge.append(np.searchsorted(part[self.order[-1]], np.arange((1 << WIDTH) + 1)))

    def near(self, query: np.ndarray, j: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of rows whose segment j is at this radius and is the first of their nearest segments."""
        own = ((query >> np.uint64(j * WIDTH)) & _LOW).astype(np.int64)
        value = own[:, None] ^ masks(radius)
        begin, count = self.edge[j][value].ravel(), (self.edge[j][value + 1] - self.edge[j][value]).ravel()
        used = np.flatnonzero(count)
        begin, count = begin[used], count[used]
        who = np.repeat(used // value.shape[1], count)
        row = self.order[j][np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        differs = self.code[row] ^ query[who]
        parts = np.stack([np.bitwise_count((differs >> np.uint64(i * WIDTH)) & _LOW) for i in range(SEGMENTS)])
        fresh = np.argmin(parts, axis=0) == j
        return who[fresh], row[fresh], parts[:, fresh].sum(0, dtype=np.int64)


def search(tables: Tables, ids: np.ndarray, query: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query, id, distance): for each query its k nearest rows here, by distance and id, none beyond its bound."""
    out = []
    for a in range(0, len(query), _LANES):
        q = query[a : a + _LANES]
        limit = bound[a : a + _LANES].copy()
        live = np.arange(len(q))
        found: list[list[np.ndarray]] = [[], [], []]
        seen = np.zeros((len(q), BITS + 1), np.int64)
        for radius in range(WIDTH + 1):
            for j in range(SEGMENTS):
                who, row, far = tables.near(q[live], j, radius)
                who = live[who]
                close = far <= limit[who]
                who, row, far = who[close], row[close], far[close]
                for x, y in zip(found, (who, row, far), strict=True):
                    x.append(y)
                np.add.at(seen, (who, far), 1)
                total = np.cumsum(seen, axis=1)
                kth = np.where(total[:, -1] >= k, np.argmax(total >= k, axis=1), BITS)
                limit = np.minimum(limit, kth)
                live = live[limit[live] > SEGMENTS * radius + j]
                if not len(live):
                    break
            if not len(live):
                break
        who, row, far = (np.concatenate(x) for x in found)
        close = far <= limit[who]
        who, row, far = who[close], ids[row[close]], far[close]
        order = np.lexsort((row, far, who))
        who, row, far = who[order], row[order], far[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((who[rank < k] + a, row[rank < k], far[rank < k]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query, itself among them, by distance and id.

    ``queries`` has the columns of ``vectors``; by default all rows whose id is
    divisible by 20. Queries go out in blocks of bounded size, each against all
    rows, and a query's bests of the parts meet by its id: k rows a part at most. A
    bounded sample of rows gives each query a first bound, which only saves
    work. Rows and queries without vector or id are left out; repeated rows are
    neighbours each, repeated queries one.
    """
    spark = vectors.sparkSession
    rows = settle(codes(vectors, key, embedding).filter("id is not null"), "codes")
    n = rows.count()
    asked = rows.filter("id % 20 = 0") if queries is None else codes(queries, key, embedding).filter("id is not null")
    asked = settle(asked.distinct(), "queries")
    blocks = 1 + asked.count() // BLOCK
    parts = max(1, min(-(-n // PART), max(spark.sparkContext.defaultParallelism * 4, n >> 22)))
    dealt = rows.repartition(parts)
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", "code")).limit(SAMPLE).select("code").collect()], np.int64).view(np.uint64)
    schema = T.StructType().add("query_id", "long").add("query_code", "long").add("vec_id", "long").add("distance", "integer")

    def against(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_batches = list(batches)
            if not all_batches:
                return
            ids = np.concatenate([b.column(0).to_numpy() for b in all_batches])
            tables = Tables(np.concatenate([b.column(1).to_numpy() for b in all_batches]).view(np.uint64))
            query_ids, query, bound = index.value
            for who, row, far in search(tables, ids, query, bound, k):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(query[who].view(np.int64)), pa.array(row), pa.array(far.astype(np.int32))], schema.names)

        return run

    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id", "code"), F.lit(blocks)) == b)
        own = part.collect()
        query = np.array([r["code"] for r in own], np.int64).view(np.uint64)
        bound = np.full(len(query), BITS)
        if len(some) >= k:
            for i, q in enumerate(query):
                bound[i] = np.partition(np.bitwise_count(some ^ q), k - 1)[k - 1]
        index = spark.sparkContext.broadcast((np.array([r["id"] for r in own], np.int64), query, bound))
        near = dealt.mapInArrow(against(index), schema)
        near = near if blocks == 1 else settle(near, "nearest")
        found = near if found is None else found.unionByName(near)
    best = Window.partitionBy("query_id", "query_code").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


SQL = """
WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT vec_id, CAST(string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS BIT) AS code FROM e GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(bit_count(xor(q.code, d.code)) AS INTEGER) AS distance FROM c q, c d WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM p) WHERE rank <= 10
"""
