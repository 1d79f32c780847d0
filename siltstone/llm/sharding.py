"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table,
and shards take turns claiming their next free slot. A key's slot, and so its
shard, is then one hash and one lookup; adding a shard moves few keys.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import hash60

#: Slots (a prime) and shards of the production table.
SLOTS, SHARDS = 65537, 64


@lru_cache(maxsize=8)
def lookup(shards: int = SHARDS, slots: int = SLOTS) -> tuple[int, ...]:
    """The shard of each slot. The names of shards alone decide, so reruns agree."""
    if not 0 < shards <= slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    if slots == 1:
        return (0,)
    digest = [hashlib.md5(f"shard-{k}".encode()).digest() for k in range(shards)]
    place = [int.from_bytes(d[:8], "big") % slots for d in digest]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    owner = [-1] * slots
    left = slots
    while left:
        for k in range(min(shards, slots)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]] = k
            left -= 1
            if not left:
                break
    return tuple(owner)


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (ints; columns of these names are replaced) to each row, without a shuffle.

    A null key counts as the empty text; equal keys share a shard, repeated rows
    stay. The broadcast table has exactly ``slots`` rows, whatever the input.
    """
    spark = docs.sparkSession
    owners = spark.createDataFrame(list(enumerate(lookup(shards, slots))), "slot int, shard int")
    at = F.pmod(hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.select(*rest, at.alias("slot")).join(F.broadcast(owners), "slot", "left").select(*rest, "slot", "shard")


SQL = """
SELECT doc_id, slot, ascii(substr('{owners}', slot + 1, 1)) - 48 AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
"""


def sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    owners = "".join(chr(48 + k) for k in lookup(shards, slots)).replace("'", "''")
    return SQL.format(owners=owners, slots=slots)
