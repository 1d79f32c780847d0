"""Shared plumbing: scratch tables in the cluster's shared folder, row keys, held-out split."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.bitmap import FILTER_BITS, maybe_in, membership
from siltstone.scratch import discard, scratch_dir, settle

__all__ = ["FILTER_BITS", "aside", "discard", "held_out", "hash60", "maybe_in", "membership", "scratch_dir", "settle", "ship", "table", "text_key"]

#: A word of the corpus: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch sent to Python at most (a longer text goes alone), so that memory does not follow the length of texts.
BATCH_BYTES = 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application, so that they need no installation, and bound their batches."""
    context = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(name).rstrip("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="siltstone-ship-"), f"{top.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its own columns of these names out of the way, and the renaming that brings them back."""
    taken, moved = set(df.columns) | set(names), {}
    for c in df.columns:
        if c in names:
            new = c + "_"
            while new in taken:
                new += "_"
            taken.add(new)
            moved[c] = new
    return df.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def text_key(text: str) -> list[Column]:
    """128 bits that stand for a text: columns k1, k2."""
    return [F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2")]


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by five (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def hash60(col: Column) -> Column:
    """A 60-bit integer from md5, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")
