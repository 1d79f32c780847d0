"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input is the embedding of its word plus those of all its runs of GRAM
characters (code points; a shorter word is one run), over the root of their number,
so that unseen words still speak through their spelling, wherever in the word it is.
A word of more than PIECE runs is several tokens, so that a long one is not watered
down. A text's score is the highest over all its overlapping windows. Labels are of
texts, so training looks for each text's most telling window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernel as K
from siltstone.llm.common import discard, settle, ship

#: Characters of a run, and runs of a token at most.
GRAM, PIECE = 4, 24
#: Tokens of a window and between the starts of two; a text's last window ends with it.
WINDOW, STRIDE = 64, 48
#: The labelled texts to learn from: at most so many of each class, by the hash of their ids, none longer than this;
#: and of each class the first of these whose bytes together stay within this, at least one.
POSITIVES, NEGATIVES, TRAIN_CHARS, TRAIN_BYTES = 1500, 3000, 20_000, 8 << 20
#: Vocabulary: inputs found in at least so many training texts, the most frequent so many; sizes of embedding and hidden state.
MIN_TEXTS, VOCABULARY, EMBED, HIDDEN = 3, 1 << 16, 8, 8
EPOCHS, UPDATES, BATCH, RATE, SEED = 6, 160, 256, 0.01, 7
#: Texts that the share of toxic texts counts for beside those in which an input occurs.
PRIOR_TEXTS = 3.0
#: A text is predicted toxic from this score on.
TOXIC = 0.5
_SLOTS, _LANES, _BLOCK = 1 << 19, 1024, 1 << 15


@dataclass
class Tokens:
    """Input hashes of the tokens of some texts: token t has word[t] and gram[edge[t]:edge[t + 1]]; bounds[d]:bounds[d + 1] are those of text d."""

    word: np.ndarray
    gram: np.ndarray
    edge: np.ndarray
    bounds: np.ndarray


def tokens(words: K.Words) -> Tokens:
    """The tokens of words: every run of GRAM code points of a word is in one of them."""
    lead = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    first, past = np.searchsorted(lead, words.start), np.searchsorted(lead, words.end)
    runs = np.maximum(1, past - first - (GRAM - 1))
    word = np.repeat(np.arange(len(words)), runs)
    place = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = first[word] + place
    begin, end = lead[at], lead[np.minimum(at + GRAM, past[word])]
    head = np.flatnonzero(place % PIECE == 0)
    edge = np.append(head, len(word))
    return Tokens(words.spans(begin[head], end[edge[1:] - 1]) ^ K.U(1), K.mix(words.spans(begin, end) + K.U(2)), edge, np.searchsorted(word[head], words.bounds))


def joined(parts: list[Tokens]) -> Tokens:
    """Tokens of the texts of all parts, one after the other."""
    word, gram = (np.concatenate([getattr(p, k) for p in parts]) for k in ("word", "gram"))
    counts, texts = (np.concatenate([np.diff(getattr(p, k)) for p in parts]) for k in ("edge", "bounds"))
    return Tokens(word, gram, np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(texts)))


def spread(edge: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams of chosen tokens, in order, and how many each token has."""
    count = edge[chosen + 1] - edge[chosen]
    return np.arange(count.sum()) + np.repeat(edge[chosen] - (np.cumsum(count) - count), count), count


def vectors(table: np.ndarray, word: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Input vectors of tokens from rows of the embedding: a word's and its grams', count of them each."""
    out = table[word]
    if len(word):
        out = out + np.add.reduceat(table[gram], np.cumsum(count) - count) / np.sqrt(count, dtype=np.float32)[:, None]
    return out


def windows(bounds: np.ndarray, length: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the windows over each text: at least one, also of no words."""
    count = np.diff(bounds)
    each = 1 + np.maximum(0, -(-(count - length) // stride))
    text = np.repeat(np.arange(len(count)), each)
    place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    offset = np.maximum(0, np.minimum(place * stride, count[text] - length))
    return text, bounds[:-1][text] + offset, np.minimum(length, count[text])


@dataclass
class Network:
    """Slots of known input hashes with rows of the embedding, and the weights. ``constant`` stands in where a class has no rows."""

    keys: np.ndarray
    rows: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the embedding, 0 for what is not in the vocabulary."""
        slot = (hashes & K.U(_SLOTS - 1)).astype(np.int32)
        return np.where(self.keys[slot] == hashes, self.rows[slot], 0)

    def embed(self, found: Tokens) -> np.ndarray:
        """The input vectors of tokens, with a row of zeros behind them."""
        out = np.zeros((len(found.word) + 1, EMBED), np.float32)
        for a in range(0, len(found.word), _BLOCK):
            edge = found.edge[a : a + _BLOCK + 1]
            words, grams = self.lookup(found.word[a : a + _BLOCK]), self.lookup(found.gram[edge[0] : edge[-1]])
            out[a : a + len(words)] = vectors(self.weights["embedding"], words, grams, np.diff(edge))
        return out

    def logits(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log odds of windows of the words embedded in x."""
        out = np.empty(len(first), np.float32)
        by_size = np.argsort(size, kind="stable")
        step = np.arange(WINDOW)[:, None]
        for a in range(0, len(first), _LANES):
            part = by_size[a : a + _LANES]
            longest = max(1, int(size[part[-1]]))
            mask = step[:longest] < size[part]
            at = np.where(mask, first[part] + step[:longest], len(x) - 1)
            out[part] = forward(self.weights, x[at], mask)[0]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 of each text."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        found = tokens(K.find_words(data, offsets, K.ALNUM, K.LOWER))
        text, first, size = windows(found.bounds)
        best = np.full(len(offsets) - 1, -30.0)
        np.maximum.at(best, text, self.logits(self.embed(found), first, size).astype(float))
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def _gru(w: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states in time order of x. Gates use sigmoid(v) = (1 + tanh(v / 2)) / 2."""
    steps, lanes, _ = x.shape
    inner, recurrent = w[f"{side}_in"], w[f"{side}_rec"]
    scale = np.ones(3 * HIDDEN, np.float32)
    scale[: 2 * HIDDEN] = 0.5
    given = x @ (inner * scale) + w[f"{side}_bias"] * scale
    recurrent = recurrent * scale
    h = np.zeros((lanes, HIDDEN), np.float32)
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    live = mask[:, :, None].astype(np.float32)
    for t in range(steps):
        a = h @ recurrent
        gate = np.tanh(given[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]) * np.float32(0.5) + np.float32(0.5)
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        n = np.tanh(given[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, a[:, 2 * HIDDEN :]))
        h = (n + z * (h - n)) * live[t]
        out[t] = h
    return out


def forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, ...]:
    """Log odds of windows x (time, window, embedding): both directions, then attention over the real words."""
    left = None if keep is None else keep.setdefault("l", [])
    right = None if keep is None else keep.setdefault("r", [])
    h = np.concatenate((_gru(w, "l", x, mask, left), _gru(w, "r", x[::-1], mask[::-1], right)[::-1]), axis=2)
    energy = np.where(mask, h @ w["attention"], -1e9)
    weight = np.exp(energy - energy.max(0)) * mask
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, h)
    return pooled @ w["out"] + w["out_bias"][0], h, weight, pooled


def _gru_back(w: dict, side: str, x: np.ndarray, mask: np.ndarray, kept: list, dh_out: np.ndarray, grad: dict) -> np.ndarray:
    recurrent = w[f"{side}_rec"]
    d_given = np.empty((*x.shape[:2], 3 * HIDDEN), np.float32)
    d_rec, dh = np.zeros_like(recurrent), np.zeros_like(dh_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, a = kept[t]
        dh = (dh + dh_out[t]) * mask[t][:, None]
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (h - n) * z * (1 - z), dn * a * r * (1 - r)
        d_given[t] = np.concatenate((dz, dr, dn), axis=1)
        da = np.concatenate((dz, dr, dn * r), axis=1)
        d_rec += h.T @ da
        dh = dh * z + da @ recurrent.T
    grad[f"{side}_rec"] = d_rec
    grad[f"{side}_in"] = np.einsum("tbe,tbg->eg", x, d_given)
    grad[f"{side}_bias"] = d_given.sum((0, 1))
    return d_given @ w[f"{side}_in"].T


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, label: np.ndarray, importance: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Weighted logistic loss, gradients of the weights and of x."""
    kept: dict = {}
    logit, h, weight, pooled = forward(w, x, mask, kept)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = -float((importance * np.where(label == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())
    d = (importance * (p - label)).astype(np.float32)
    grad: dict = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * w["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, h)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    grad["attention"] = np.einsum("tb,tbh->h", d_energy, h)
    dh = weight[:, :, None] * d_pooled + d_energy[:, :, None] * w["attention"]
    dx = _gru_back(w, "l", x, mask, kept["l"], dh[:, :, :HIDDEN], grad)
    dx = dx + _gru_back(w, "r", x[::-1], mask[::-1], kept["r"], dh[::-1, :, HIDDEN:], grad)[::-1]
    return loss, grad, dx


def train(column, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit on the texts of an Arrow column and their labels."""
    nothing = np.zeros(0)
    if not (labels == 1).any() or not (labels == 0).any():
        return Network(nothing, nothing, {}, float((labels == 1).sum() / (len(labels) + 1)))
    found = joined([tokens(K.find_words(data, offsets, K.ALNUM, K.LOWER)) for _, _, data, offsets in K.slices(column)])
    bounds, n_tokens = found.bounds, len(found.word)
    doc = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(bounds))

    # Vocabulary, and the log odds of each entry as the first coordinate of its embedding.
    entries = []
    for h, owner in ((found.word, doc), (found.gram, np.repeat(doc, np.diff(found.edge)))):
        _, one = np.unique(K.mix(h ^ K.mix(owner.astype(K.U) + K.U(1))), return_index=True)
        own, inverse, texts = np.unique(h[one], return_inverse=True, return_counts=True)
        entries.append((own, texts, np.bincount(inverse, weights=labels[owner[one]] == 1, minlength=len(own))))
    known, texts, toxic = (np.concatenate(e) for e in zip(*entries, strict=True))
    often = np.flatnonzero(texts >= MIN_TEXTS)
    often = often[np.argsort(-texts[often], kind="stable")][:VOCABULARY]
    known, texts, toxic = known[often], texts[often], toxic[often]
    share = (labels == 1).mean()
    telling = np.log((toxic + PRIOR_TEXTS * share) / (texts - toxic + PRIOR_TEXTS * (1 - share))) - np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (len(known) + 1, EMBED)).astype(np.float32)
    table[1:, 0] = np.clip(telling, -4, 4) / 4
    table[0] = 0
    order = np.argsort(np.abs(telling), kind="stable")
    keys, rows = np.zeros(_SLOTS, K.U), np.zeros(_SLOTS, np.int32)
    slot = (known[order] & K.U(_SLOTS - 1)).astype(np.int64)
    keys[slot], rows[slot] = known[order], order + 1

    wide = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"embedding": table, "attention": wide(2 * HIDDEN), "out": wide(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
    for side in "lr":
        w |= {f"{side}_in": wide(EMBED, 3 * HIDDEN), f"{side}_rec": wide(HIDDEN, 3 * HIDDEN), f"{side}_bias": np.zeros(3 * HIDDEN, np.float32)}
    net = Network(keys, rows, w)

    word_rows, gram_rows = net.lookup(found.word), net.lookup(found.gram)
    text, first, size = windows(bounds)
    starts = np.searchsorted(text, np.arange(len(labels)))
    step = np.arange(WINDOW)[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    # Both classes weigh half.
    weigh = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    clean = np.flatnonzero(labels[doc] == 0)
    batch = int(np.clip(len(labels) // 12, 32, BATCH))
    turn, epoch = 0, -1
    while (epoch := epoch + 1) < epochs or turn < UPDATES:
        x = net.embed(found)
        if epoch:
            worth = net.logits(x, first, size)
        else:
            run = np.concatenate(([0.0], np.cumsum(np.maximum(x[:-1, 0], 0), dtype=float)))
            worth = run[first + size] - run[first]
        by = np.lexsort((-worth, text))
        chosen = by[starts]
        other = starts + (rng.random(len(starts)) * np.diff(np.append(starts, len(text)))).astype(int)
        # Any window of a clean text is clean; of a toxic one only the most telling is known to be toxic.
        use = np.concatenate((chosen, other[labels == 0]))
        rng.shuffle(use)
        for a in range(0, len(use), batch):
            part = use[a : a + batch]
            longest = max(1, int(size[part].max()))
            mask = step[:longest] < size[part]
            at = np.where(mask, first[part] + step[:longest], n_tokens)
            if len(clean):
                # A word of clean texts, repeated through a window, is clean as well.
                same = np.broadcast_to(rng.choice(clean, max(1, len(part) // 8)), (longest, max(1, len(part) // 8)))
                at, mask = np.concatenate((at, same), axis=1), np.concatenate((mask, np.ones(same.shape, bool)), axis=1)
            goal = np.zeros(at.shape[1])
            goal[: len(part)] = labels[text[part]]
            importance = np.full(at.shape[1], 0.5)
            importance[: len(part)] = weigh[text[part]]
            token = at[mask]
            places, count = spread(found.edge, token)
            x_part = np.zeros((*at.shape, EMBED), np.float32)
            x_part[mask] = vectors(table, word_rows[token], gram_rows[places], count)
            _, grad, dx = gradients(w, x_part, mask, goal, importance / len(part))
            d = dx[mask]
            rows_hit = np.concatenate((word_rows[token], gram_rows[places]))
            d = np.concatenate((d, np.repeat(d / np.sqrt(count, dtype=np.float32)[:, None], count, axis=0)))
            flat = np.stack([np.bincount(rows_hit, weights=d[:, c], minlength=len(table)) for c in range(EMBED)], axis=1).astype(np.float32)
            flat[0] = 0
            grad["embedding"] = flat
            turn += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-6)
    return net


def sample(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", name: str = "toxic") -> pa.Table:
    """(text, label) of a bounded sample of labelled rows that are not held out, chosen by the hash of their ids."""
    from siltstone.llm.quality import training_labels

    known = training_labels(labels, name, key)
    ids = None
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        part = known.filter(F.col(name) == value).orderBy(F.xxhash64(key), key).limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # At most POSITIVES + NEGATIVES ids, whatever the input.
    rows = docs.filter(F.length(text) <= TRAIN_CHARS).select(key, text).join(F.broadcast(ids), key)
    found = settle(rows.groupBy(key).agg(F.min(text).alias("text"), F.first(name).cast("int").alias("label")), "train")
    # The bound holds before a text comes to the driver; rows of a class are at most POSITIVES or NEGATIVES here.
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64(key), key)
    total = F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))
    sized = found.select(key, "label", total.alias("bytes"), F.row_number().over(by_hash).alias("n"))
    kept = sized.filter((F.col("bytes") <= TRAIN_BYTES) | (F.col("n") == 1)).select(F.col(key).alias("_kept"))
    out = found.join(F.broadcast(kept), F.col(key) == F.col("_kept"), "left_semi").orderBy(key).select("text", "label").toArrow()
    discard(found)
    return out


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", name: str = "toxic", drop_text: bool = False) -> DataFrame:
    """``docs`` with its columns, ``score`` and ``predicted``: one scan after training on a bounded sample, no shuffle.

    Null and empty texts are one window of no words; long ones are scored whole. Repeated rows are scored
    alike, and an empty table gives none. If the sample lacks a class, all rows have the share of label 1.
    Columns named ``score`` or ``predicted`` are replaced.
    """
    spark = ship(docs.sparkSession)
    rows = sample(docs, labels, text=text, key=key, name=name)
    net = spark.sparkContext.broadcast(train(rows["text"], rows["label"].to_numpy()))
    rest = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    kept = [c for c in rest.columns if c != text or not drop_text]
    schema = T.StructType([*(rest.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [net.value.score(data, offsets) for _, _, data, offsets in K.slices(batch.column(batch.schema.get_field_index(text)))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), scores], [*kept, "score"])

    return rest.mapInArrow(scan, schema).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
