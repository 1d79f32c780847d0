"""A bitmap of keys that drops rows which surely need no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a membership filter; its broadcast is at most this many / 64 rows whatever the input.
FILTER_BITS = 1 << 24


def membership(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom-like bitmap of the values in ``key``: (slot, bits), at most ``bits / 64`` rows."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    return (
        keys.select(F.expr("1").alias("one"), place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("_m_slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("_m_bits"))
    )


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Mark the rows that may be among the keys of ``bitmap``: adds boolean ``_maybe``, never false for a key.

    The bitmap's row count is bounded by ``bits``, so its broadcast is bounded too;
    over very large key sets it fills up and lets all rows pass, which later exact joins undo.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    joined = df.withColumn("_m_at", place).withColumn("_m_slot", F.shiftright("_m_at", 6)).join(F.broadcast(bitmap), "_m_slot", "left")
    hit = F.expr("coalesce((_m_bits & shiftleft(1L, cast(_m_at & 63 as int))) != 0, false)")
    return joined.withColumn("_maybe", hit).drop("_m_at", "_m_slot", "_m_bits")
