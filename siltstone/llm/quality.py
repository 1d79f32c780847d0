"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernel as K
from siltstone.llm.common import aside, held_out, ship

#: The statistics, in order; all are logarithms or log odds, see ``statistics``.
FEATURES = ("words", "word_bytes", "symbols", "capitals", "digits", "stops", "bare", "echo", "spread", "novel", "lines", "long_words")
#: Shrinkage of a class covariance towards its own diagonal, and towards the pooled covariance.
TO_DIAGONAL, TO_POOLED, RIDGE = 0.05, 0.05, 1e-3
#: A row is predicted good from this score on.
KEEP = 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*+/<=>@\\^_`{|}~!?"]] = True
_UPPER, _DIGIT, _STOP, _LINE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = _STOP[[*b".,;:"]] = _LINE[10] = True


#: Rows that a rate counts in addition, at its usual value, so that short texts look usual unless they say otherwise.
PSEUDO = 12


def _log_odds(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
    part = np.minimum(part, whole)
    return np.log((part + PSEUDO * usual) / (whole - part + PSEUDO * (1 - usual)))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each text has, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    _, first, count = np.unique(K.mix(hashes ^ K.mix(doc.astype(K.U) + K.U(1))), return_index=True, return_counts=True)
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, doc[first], count)
    return np.bincount(doc[first], minlength=n_docs), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has the values of zero counts."""
    n = len(offsets) - 1
    words = K.find_words(data, offsets, K.NON_SPACE)
    count, doc = words.count, words.doc
    size = np.diff(offsets)
    length = words.end - words.start
    solid = _sums(K.NON_SPACE[data], offsets)
    letters = _sums(K.ALNUM[K.LOWER[data]], offsets)
    symbol, upper, digit, stop = (_sums(kind[data], offsets) for kind in (_SYMBOL, _UPPER, _DIGIT, _STOP))
    hashes = words.hashes()
    alnum = np.concatenate(([0], np.cumsum(K.ALNUM[K.LOWER[data]], dtype=np.int64)))
    bare = np.bincount(doc[alnum[words.end] == alnum[words.start]], minlength=n)
    echo = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(doc) else np.zeros(n, np.int64)
    kinds, top = _repeats(hashes, doc, n)
    three = K.grams(hashes, 3)
    inside = doc[: len(three)] == doc[2:] if len(three) else np.zeros(0, bool)
    own, _ = _repeats(three[inside], doc[: len(three)][inside], n)
    out = np.stack(
        [
            np.log1p(count),
            np.log((solid + 6 * PSEUDO) / (count + PSEUDO)),
            _log_odds(symbol, solid, 0.01),
            _log_odds(upper, letters, 0.03),
            _log_odds(digit, letters, 0.005),
            _log_odds(stop, count, 0.1),
            _log_odds(bare, count, 0.01),
            _log_odds(echo, count, 0.01),
            _log_odds(np.maximum(top - 1, 0), count, 0.06),
            _log_odds(np.maximum(count - 2, 0) - own, np.maximum(count - 2, 0), 0.01),
            _log_odds(_sums(_LINE[data], offsets), count, 0.02),
            _log_odds(np.bincount(doc[length > 14], minlength=n), count, 0.05),
        ],
        axis=1,
    )
    assert len(size) == n
    return out


def with_statistics(docs: DataFrame, text: str = "text", *, drop_text: bool = False, out: str = "statistics") -> DataFrame:
    """Add the array ``out`` of FEATURES to each row (null text: as an empty one); one scan, no shuffle."""
    ship(docs.sparkSession)
    rest = docs.select(*[c for c in docs.columns if c != out])
    kept = [c for c in rest.columns if c != text or not drop_text]
    schema = T.StructType([*(rest.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in K.slices(batch.column(batch.schema.get_field_index(text)))]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), rows], [*kept, out])

    return rest.mapInArrow(scan, schema)


@dataclass
class Model:
    """Log prior odds, and for class 0 and 1 the mean, the inverse Cholesky factor and its log determinant."""

    prior: float
    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    def score(self, x: Column) -> Column:
        """Probability of class 1 from the difference of Mahalanobis log densities, as one SQL expression."""
        size = self.mean.shape[1]
        value = [x[j] for j in range(size)]
        density = []
        for k in (0, 1):
            total = F.lit(float(self.log_det[k]))
            for i in range(size):
                z = F.lit(-float(self.inverse[k, i, : i + 1] @ self.mean[k, : i + 1]))
                for j in range(i + 1):
                    z = z + value[j] * float(self.inverse[k, i, j])
                total = total - z * z * 0.5
            density.append(total)
        odds = density[1] - density[0] + self.prior
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def from_moments(count: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Model:
    """The model from each class's row count, sums and sums of products. A class without rows takes the pooled moments."""
    size = total.shape[1]
    n = np.maximum(count, 1)[:, None, None]
    everything = max(count.sum(), 1)
    grand = total.sum(0) / everything
    mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], grand)
    within = outer - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = within.sum(0) / everything + RIDGE * np.eye(size)
    inverse, log_det = np.zeros((2, size, size)), np.zeros(2)
    for k in (0, 1):
        own = within[k] / n[k] if count[k] > 1 else pooled
        # Few rows shrink further: the weight of the pooled covariance falls with the rows per parameter.
        lean = min(1.0, TO_POOLED + size / (size + count[k]))
        own = (1 - lean) * own + lean * pooled
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(size)
        factor = np.linalg.cholesky(own)
        inverse[k] = np.linalg.inv(factor)
        log_det[k] = -np.log(np.diag(factor)).sum()
    return Model(float(np.log((count[1] + 1) / (count[0] + 1))), mean, inverse, log_det)


def fit(rows: DataFrame, label: str, x: str = "statistics") -> Model:
    """Fit on all rows with label 0 or 1: one aggregation of sums and products, whatever the number of rows."""
    size = len(FEATURES)
    value = [F.col(x)[j] for j in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    sums = [F.sum(v).alias(f"s{j}") for j, v in enumerate(value)]
    products = [F.sum(value[i] * value[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("_class")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    count, total, outer = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
    for r in found:
        k = r["_class"]
        count[k] = r["n"]
        total[k] = [r[f"s{j}"] for j in range(size)]
        for i, j in pairs:
            outer[k, i, j] = outer[k, j, i] = r[f"p{i}_{j}"]
    return from_moments(count, total, outer)


def training_labels(labels: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """(key, name) of the labels that may be learned from: not held out, not null; of several for a key the largest."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(name).isNotNull() & ~held_out(key))
    return rows.groupBy(key).agg(F.max(name).alias(name))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", name: str = "quality") -> DataFrame:
    """``docs`` with its columns, ``score`` and ``predicted``; fitted on all labelled rows that are not held out.

    The statistics are computed in two scans, once for the labelled rows (without
    the texts, which never leave the scan) and once as scores are attached. Empty,
    null and very long texts are scored like any other, repeated rows alike; without
    labels all score 0.5, and an empty table gives none. Columns named ``score`` or
    ``predicted`` are replaced, all others keep their values.
    """
    seen = with_statistics(docs.select(key, text), text, drop_text=True).join(training_labels(labels, name, key), key)
    model = fit(seen, name)
    rest, back = aside(docs.select(*[c for c in docs.columns if c not in ("score", "predicted")]), "statistics")
    out = with_statistics(rest, text).withColumn("score", model.score(F.col("statistics"))).drop("statistics")
    return out.withColumnsRenamed(back).withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", name: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns and values, ``score`` and ``predicted`` included."""
    moved, back = aside(docs, "score", "predicted")
    return classify(moved, labels, text=text, key=key, name=name).filter("predicted = 1").select(*moved.columns).withColumnsRenamed(back)
