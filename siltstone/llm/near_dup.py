"""Near-duplicate detection by order MinHash, verified by banded alignment.

Each of HASHES hash functions picks the PICKS least of a text's SHINGLE-word
shingles, labelled by occurrence, and keeps them in text order. Every two of them, in
that order, are a value of the text; texts that share a value share a bucket. The
begin and the end of a text are shingles too, and short texts have values of shingles
of two words besides, under the same rule.

Each text is first aligned with two hubs of its buckets and with its likeliest
partner elsewhere. What these links leave
apart in a bucket, near enough in length, is compared pair by pair by word histograms, which bound the edit
distance from below and so lose no pair; texts with such partners meet in their
bucket and are aligned there, the likeliest pairs first, unless they are linked
already. Large buckets are compared block by block. The texts of those of more than
CROWD blocks, such as all that have a line in common, meet by their rare words
instead: texts that align share one of the rarest fifth of each, so none is lost.
Verified links make classes: those of all aligned pairs of all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernel as K
from siltstone.llm.common import discard, maybe_in, membership, settle, ship, text_key
from siltstone.operators.graph import components

#: Words of a shingle; least share of words that stay in an alignment; hash functions and shingles that each picks.
SHINGLE, SIMILAR, HASHES, PICKS = 5, 0.8, 20, 4
#: Texts of so many words at most are known by shingles of two words as well, of so many hash functions.
SHORT, SHORT_HASHES = 64, 4
#: Bins of a text's word histogram; words of the members of a bucket (a member counting BINS more) that one task compares with as many others.
BINS, BLOCK = 256, 1 << 20
#: Blocks of a bucket above which its texts meet by rare words; bits of a word's hash by which words are counted.
CROWD, _SLOT = 4, 18
#: Texts that may align are in the same band of lengths, by logarithm, or in neighbours.
_BAND = math.log(1.04 / SIMILAR)
#: Pairs compared at a time in a task; alignments between two looks at what is linked by then; members in a tile of pairs; pairs held to be ordered.
_LANES, _TURN, _TILE, _HELD = 1 << 15, 256, 2048, 1 << 20
_PLACE = 28
_SEEDS = K.mix(np.arange(1, 2 * HASHES + 1, dtype=K.U) * K.U(0xA0761D6478BD642F)).reshape(2, HASHES) | K.U(1)
#: Far from any row number, with whose hashes they are mixed.
_BEGIN, _END = K.mix(np.array([1 << 62, 3 << 61], K.U))


def _pool(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with words, start of each one's stretch, shingle hashes): a begin, the shingles in order and an end for each.

    A text under SHINGLE words has one shingle, all its words.
    """
    text = np.flatnonzero(words.count)
    count = words.count[text]
    grams = np.zeros(len(words), K.U)
    hashes = words.hashes()
    whole = K.grams(hashes, SHINGLE)
    grams[: len(whole)] = whole
    for d in text[count < SHINGLE].tolist():
        own = hashes[words.bounds[d] : words.bounds[d + 1]]
        grams[words.bounds[d]] = K.grams(own, len(own))[0]
    size = np.maximum(count - SHINGLE + 1, 1) + 2
    start = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(start, size)
    pool = np.zeros(len(place), K.U)
    inside = (place > 0) & (place < np.repeat(size, size) - 1)
    pool[inside] = grams[(np.repeat(words.bounds[text], size) + place - 1)[inside]]
    pool[start], pool[start + size - 1] = _BEGIN, _END
    return text, start, pool


def _short_pool(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_pool``, of shingles of two words, for the texts of SHINGLE - 1 to SHORT words; without begin and end."""
    text = np.flatnonzero((words.count >= SHINGLE - 1) & (words.count <= SHORT))
    size = words.count[text] - 1
    start = np.cumsum(size) - size
    place = np.repeat(words.bounds[text] - start, size) + np.arange(size.sum())
    return text, start, K.grams(words.hashes(), 2)[place]


def _labelled(pool: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes of a pool, with occurrences of one in the same text told apart by number."""
    own = K.mix(pool ^ K.mix(owner.astype(K.U) + K.U(1)))
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
    number = np.empty(len(pool), K.U)
    number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return K.mix(pool + number * K.U(0x9E3779B97F4A7C15))


def _values(pool: np.ndarray, start: np.ndarray, hashes: int) -> np.ndarray:
    """A row of values for each stretch of the pool, of every two picks of each hash function; 0 where there is none."""
    two = list(combinations(range(PICKS), 2))
    out = np.zeros((len(start), hashes * len(two)), K.U)
    size = np.diff(np.append(start, len(pool)))
    owner = np.repeat(np.arange(len(start)), size)
    labelled = _labelled(pool, owner)
    place = (np.arange(len(pool)) - start[owner]).astype(K.U)
    low, none = K.U((1 << _PLACE) - 1), K.U(0xFFFFFFFFFFFFFFFF)
    for j in range(hashes):
        value = (labelled ^ _SEEDS[0, j]) * _SEEDS[1, j]
        value ^= value >> K.U(32)
        value = (value & ~low) | place
        picked = []
        for _ in range(PICKS):
            least = np.minimum.reduceat(value, start)
            spot = np.where(least == none, len(pool), start + (least & low).astype(np.int64))
            picked.append(spot)
            value[spot[least != none]] = none
        picked = np.sort(np.stack(picked), axis=0)
        for k, (a, b) in enumerate(two):
            there = picked[b] < len(pool)
            x, y = pool[picked[a][there]], pool[picked[b][there]]
            both = K.mix(x * K.U(0xD6E8FEB86659FD93) + K.mix(y))
            out[there, j * len(two) + k] = np.where((x == _BEGIN) & (y == _END), K.U(0), both)
    return out


def sketch(words: K.Words) -> np.ndarray:
    """One row of values for each text, of every two picks of each hash function; 0 where there is none.

    Equal values say that two texts have the same two shingles in the same order. Texts
    of SHORT words or fewer have values of shingles of two words besides, as few of
    their longer shingles outlive a change. A text without words has zeros only.
    """
    per = PICKS * (PICKS - 1) // 2
    out = np.zeros((len(words.bounds) - 1, (HASHES + SHORT_HASHES) * per), K.U)
    for hashes, at, (text, start, pool) in ((HASHES, 0, _pool(words)), (SHORT_HASHES, HASHES * per, _short_pool(words))) if len(words) else ():
        if len(pool):
            out[text, at : at + hashes * per] = _values(pool, start, hashes)
    return out


def histograms(words: K.Words) -> np.ndarray:
    """How many words of each text fall in each of BINS bins, 255 at most: a row of bytes for each text."""
    n = len(words.bounds) - 1
    out = np.zeros((n, BINS), np.uint8)
    bin_ = (words.hashes() >> K.U(64 - BINS.bit_length() + 1)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    for a in range(0, n, 4096):
        b = min(n, a + 4096)
        i, j = words.bounds[a], words.bounds[b]
        owner = np.repeat(np.arange(b - a), words.count[a:b])
        out[a:b] = np.minimum(np.bincount(owner * BINS + bin_[i:j], minlength=(b - a) * BINS), 255).reshape(b - a, BINS)
    return out


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the edit distances of the texts of paired histograms.

    An edit changes at most one word on each side, so the words of one text beyond
    those of the other, bin by bin, have to be edited.
    """
    common = np.minimum(a, b).sum(1, dtype=np.int64)
    return np.maximum(a.sum(1, dtype=np.int64), b.sum(1, dtype=np.int64)) - common


def most_edits(a_words: np.ndarray, b_words: np.ndarray) -> np.ndarray:
    """Edits that an alignment of texts of so many words may have."""
    return (np.maximum(a_words, b_words) * (1 - SIMILAR) + 1e-9).astype(np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U(64 - _SLOT)).astype(np.int64)


def rare_words(words: K.Words, rank: np.ndarray) -> list[np.ndarray]:
    """The rarest words of each text by the rank of their hash's first bits, one more than an alignment may edit.

    Occurrences of a word are told apart. Whatever the ranks, texts that align share one
    of these: they have all words but ``most_edits`` of the longer one in common, so the
    first of the common words, by rank, comes so early in both.
    """
    if not len(words):
        return [np.zeros(0, np.int64)] * len(words.count)
    owner, hashes = np.repeat(np.arange(len(words.count)), words.count), words.hashes()
    labelled = _labelled(hashes, owner)
    order = np.lexsort((labelled, rank[_slots(hashes)], owner))
    most = np.minimum(most_edits(words.count, words.count) + 1, words.count)
    return [labelled[order[a : a + n]].view(np.int64) for a, n in zip(words.bounds[:-1].tolist(), most.tolist(), strict=True)]


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences of hashes, or most + 1 if it is larger; only a band of diagonals is kept.

    Bit t of a column stands for row j - k + t, so the band moves along the
    diagonal; vertical and horizontal differences are bits of Python integers.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    same = int(np.argmin(np.append(a[: len(b)] == b, False)))
    a, b = a[same:], b[same:]
    same = int(np.argmin(np.append((a[len(a) - len(b) :] == b)[::-1], False)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    m, n = len(a), len(b)
    if not n:
        return m
    # Words without a partner have to be edited.
    kinds, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    common = np.minimum(np.bincount(inverse[:m], minlength=len(kinds)), np.bincount(inverse[m:], minlength=len(kinds))).sum()
    if m - common > most:
        return most + 1
    k = min(most, m)
    rows: dict[int, int] = {}
    for i, w in enumerate(inverse[:m].tolist()):
        rows[w] = rows.get(w, 0) | 1 << i
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down, now, give_up = full ^ ((1 << k) - 1), 0, k, 2 * k + n - m
    edge = 1 << max(0, width - 2)
    for j, w in enumerate(inverse[m:].tolist()):
        match = rows.get(w, 0)
        match = (match >> (j - k) if j >= k else match << (k - j)) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        if j < m - k:
            now += not diagonal & top
        else:
            now += bool(right & edge) - bool(left & edge)
            edge >>= 1
        if now > give_up:
            return most + 1
        up = (left | ~((diagonal >> 1) | right)) & full
        down = (diagonal >> 1) & right
    return min(now, most + 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """At least SIMILAR of the longer text's words stay in the best alignment."""
    longest = max(len(a), len(b))
    most = int(longest * (1 - SIMILAR) + 1e-9)
    return distance(a, b, most) <= most


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column) -> np.ndarray:
    """A column of _strings as rows of bytes."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, BINS)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, bins = [np.zeros(0, np.int64)], [np.zeros((0, BINS), np.uint8)]
        values, sizes = [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in K.slices(batch.column(2)):
            words = K.find_words(data, offsets, K.NON_SPACE)
            count.append(words.count)
            bins.append(histograms(words))
            own = np.sort(sketch(words), axis=1)
            keep = own != 0
            keep[:, 1:] &= own[:, 1:] != own[:, :-1]
            values.append(own[keep])
            sizes.append(keep.sum(1))
        edge = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(values).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(count).astype(np.int64)), lists, _strings(np.concatenate(bins)), batch.column(3)], ["k1", "k2", "n_words", "sketch", "bins", "doc"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many words have a hash of these first bits."""
    count = np.zeros(1 << _SLOT, np.int64)
    for batch in batches:
        for _, _, data, offsets in K.slices(batch.column(0)):
            words = K.find_words(data, offsets, K.NON_SPACE)
            if len(words):
                count += np.bincount(_slots(words.hashes()), minlength=1 << _SLOT)
    slot = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(k1, k2, rarest) of texts."""
    for batch in batches:
        own = [w for _, _, data, offsets in K.slices(batch.column(2)) for w in rare_words(K.find_words(data, offsets, K.NON_SPACE), rank)]
        edge = np.cumsum([0, *map(len, own)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k1", "k2", "rarest"])


def _verify(batches: Iterator[pa.RecordBatch], sharing: bool = False) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b) whose texts align and, if asked, share a value."""

    def sequences(column) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        for i, j, data, offsets in K.slices(column):
            words = K.find_words(data, offsets, K.NON_SPACE)
            hashes, values = words.hashes(), sketch(words) if sharing else [None] * (j - i)
            for d in range(j - i):
                yield hashes[words.bounds[d] : words.bounds[d + 1]], values[d]

    for batch in batches:
        both = zip(sequences(batch.column(2)), sequences(batch.column(3)), strict=True)
        good = [(not sharing or _share(v, w)) and similar(a, b) for (a, v), (b, w) in both]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _share(a: np.ndarray, b: np.ndarray) -> bool:
    """Two rows of a sketch have a value in common."""
    return bool(np.intersect1d(a, b).any())


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b) that their histograms allow."""
    for batch in batches:
        a_words, b_words = (batch.column(k).to_numpy() for k in (2, 4))
        keep = least_edits(_bytes(batch.column(3)), _bytes(batch.column(5))) <= most_edits(a_words, b_words)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


#: A group is a pair of blocks x, y of a bucket, of texts with a value or (rare) a rare word in common; part is the member's own block. Where x and y differ, its pairs are those of one block with the other.
_GROUP = ["rare", "one", "x", "y"]
_MEMBER = T.StructType().add("rare", "integer").add("one", "long").add("x", "integer").add("y", "integer").add("part", "integer").add("root", "long").add("id", "long").add("n_words", "long")


def _starts(column: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the named columns."""
    out = np.ones(len(column[names[0]]), bool)
    out[1:] = False
    for c in names:
        out[1:] |= column[c][1:] != column[c][:-1]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that no group, of rows in order, goes on in the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(_starts({c: batch.column(c).to_numpy() for c in _GROUP}, _GROUP))[-1])
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held


def _across(column: dict[str, np.ndarray], bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of the pairs in a group with unlike roots that may align, of members in order of group and root."""
    n = len(bins)
    group = _starts(column, _GROUP)
    family = _starts(column, [*_GROUP, "root"])
    # Members of other roots in the same group follow the own root's.
    begin = np.append(np.flatnonzero(family), n)[np.cumsum(family)]
    count = np.append(np.flatnonzero(group), n)[np.cumsum(group)] - begin
    done, words = np.cumsum(count), column["n_words"]
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _LANES, "right")))
        own = count[at:upto]
        i = np.repeat(np.arange(at, upto), own)
        j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = upto
        keep = (column["x"][i] == column["y"][i]) | (column["part"][i] != column["part"][j])
        keep &= np.minimum(words[i], words[j]) >= np.maximum(words[i], words[j]) * SIMILAR
        i, j = i[keep], j[keep]
        for k in range(0, len(i), _LANES):
            p, q = i[k : k + _LANES], j[k : k + _LANES]
            least = least_edits(bins[p], bins[q])
            good = np.flatnonzero(least <= most_edits(words[p], words[q]))
            yield p[good], q[good], least[good]


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the members that may align with one of another root in their group."""
    for batch in _whole_groups(batches):
        column = {c: batch.column(c).to_numpy() for c in _MEMBER.names}
        some = np.zeros(batch.num_rows, bool)
        for i, j, _ in _across(column, _bytes(batch.column("bins"))):
            some[i] = some[j] = True
        yield batch.select(_MEMBER.names).filter(pa.array(some))


def _likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, least) of each member a and that of another root in its groups with the lowest bound."""
    for batch in _whole_groups(batches):
        column = {c: batch.column(c).to_numpy() for c in _MEMBER.names}
        found = np.zeros((3, 0), np.int64)
        for i, j, least in _across(column, _bytes(batch.column("bins"))):
            both = np.stack((np.append(column["id"][i], column["id"][j]), np.append(column["id"][j], column["id"][i]), np.append(least, least)))
            found = np.concatenate((found, both), axis=1)
            found = found[:, np.lexsort((found[2], found[0]))]
            found = found[:, np.append(True, np.diff(found[0]) != 0)[: found.shape[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], _FOUND.names)


def _meet_here(values: list[np.ndarray], one: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of members share no value below that of their bucket, and so meet in no earlier one; a tile of members at a time."""
    keep = np.ones(len(p), bool)
    tile = (p // _TILE) * (1 + len(values) // _TILE) + q // _TILE
    order = np.argsort(tile, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1) if len(order) else []:
        first = [int(x[at[0]]) // _TILE * _TILE for x in (p, q)]
        sides = [[v[v < np.int64(one)] for v in values[f : f + _TILE]] for f in first]
        flat = [np.concatenate(side) for side in sides]
        owner = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in sides]
        known = np.intersect1d(*flat)
        total = np.zeros((len(sides[0]), len(sides[1])), bool)
        for k in range(0, len(known), 4096):
            here, tables = known[k : k + 4096], []
            for side, own, v in zip(sides, owner, flat, strict=True):
                spot = np.minimum(np.searchsorted(here, v), len(here) - 1)
                hit = here[spot] == v
                table = np.zeros((len(side), len(here)), np.float32)
                table[own[hit], spot[hit]] = 1
                tables.append(table)
            total |= tables[0] @ tables[1].T > 0
        keep[at] = ~total[p[at] - first[0], q[at] - first[1]]
    return keep


def _held(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Pairs as rows of i, j and bound, about _HELD at a time."""
    held: list[np.ndarray] = []
    n = 0
    for part in parts:
        held.append(np.stack(part))
        n += len(part[0])
        if n >= _HELD:
            yield np.concatenate(held, axis=1)
            held, n = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def _linked(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from members with their texts: in each group alignments of unlike roots, until what aligns is linked.

    A pair that meets in several buckets is looked at in that of its least value, or in
    that of its least rare word if it shares a value at all.
    """
    for batch in _whole_groups(batches):
        column = {c: batch.column(c).to_numpy() for c in _MEMBER.names}
        sequences, values, rarest, bins = [], [], [], []
        for i, j, data, offsets in K.slices(batch.column("text")):
            words = K.find_words(data, offsets, K.NON_SPACE)
            hashes = words.hashes()
            sequences += [hashes[words.bounds[d] : words.bounds[d + 1]] for d in range(j - i)]
            values += list(sketch(words).view(np.int64))
            rarest += rare_words(words, rank) if column["rare"][i:j].any() else [None] * (j - i)
            bins.append(histograms(words))
        starts = np.append(np.flatnonzero(_starts(column, _GROUP)), batch.num_rows)
        label = np.cumsum(_starts(column, [*_GROUP, "root"]))
        links: list[tuple[int, int]] = []
        for found in _held(_across(column, np.concatenate(bins))):
            i, j, least = found[:, label[found[0]] != label[found[1]]]
            group = np.searchsorted(starts, i, "right") - 1
            order = np.lexsort((least, group))
            i, j, group = i[order], j[order], group[order]
            edges = np.flatnonzero(np.append(True, np.diff(group) != 0)) if len(group) else np.zeros(0, np.int64)
            for a, b in zip(edges, np.append(edges[1:], len(group)), strict=True):
                first, last = starts[group[a]], starts[group[a] + 1]
                p, q = i[a:b] - first, j[a:b] - first
                rare = bool(column["rare"][first])
                keep = _meet_here([np.sort(v) for v in rarest[first:last]] if rare else [np.unique(v[v != 0]) for v in values[first:last]], column["one"][first], p, q)
                p, q = p[keep], q[keep]
                own = label[first:last]
                while len(p):
                    for x, y in zip(p[:_TURN].tolist(), q[:_TURN].tolist(), strict=True):
                        if own[x] != own[y] and (not rare or _share(values[first + x], values[first + y])) and similar(sequences[first + x], sequences[first + y]):
                            links.append((first + x, first + y))
                            own[own == own[y]] = own[x]
                    p, q = p[_TURN:], q[_TURN:]
                    apart = own[p] != own[q]
                    p, q = p[apart], q[apart]
        at = np.array(links, np.int64).reshape(-1, 2)
        ids = np.sort(column["id"][at], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 1]), pa.array(ids[:, 0])], ["a", "b"])


_PAIR = T.StructType().add("a", "long").add("b", "long")
_FOUND = T.StructType().add("a", "long").add("b", "long").add("least", "long")


def _hubs(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Table (a, b), b < a: each text with two hubs of its buckets, the least one and that of its largest bucket, if they may align.

    The hub of a bucket is its text with the least id.
    """
    pick = member.filter("id != b").groupBy("id").agg(F.min("b").alias("least"), F.max(F.struct("n", "b")).alias("most"))
    pairs = pick.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("least", "most.b"))).alias("b"))
    size = nodes.select("id", "n_words", "bins")
    sized = pairs.join(size.toDF("a", "a_words", "a_bins"), "a").join(size.toDF("b", "b_words", "b_bins"), "b")
    sized = sized.filter(F.least("a_words", "b_words") >= F.greatest("a_words", "b_words") * SIMILAR)
    return settle(sized.select("a", "b", "a_words", "a_bins", "b_words", "b_bins").mapInArrow(_plausible, _PAIR), "hubs", release=True)


def _open(nodes: DataFrame, member: DataFrame, links: DataFrame) -> DataFrame:
    """Members (rare, one, id, root, blocks, members) of the buckets that ``links`` do not lead together; root is the least text that they lead to."""
    roots = components(links)
    known = nodes.select("id", "n_words").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n_words", F.coalesce("root", "id").alias("root"))
    rooted = settle(member.select("rare", "one", "id").join(known, "id"), "rooted", release=True)
    out = _apart(rooted)
    discard(roots, rooted)
    return out


def _apart(rooted: DataFrame) -> DataFrame:
    """Table of the members that have one of another root in their bucket whose length allows an alignment.

    Of buckets with the same members (known by 128 bits and their number) only that of
    the least value stays, which is where a pair of them is looked at.
    """
    one = ["rare", "one"]
    same = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.count(F.lit(1)).alias("n")]
    split = rooted.groupBy(*one).agg(F.min("root").alias("least"), F.max("root").alias("most"), *same).filter("least < most")
    split = split.groupBy("rare", "x", "y", "n").agg(F.min("one").alias("one")).select(*one)
    wide = settle(rooted.join(split, one).withColumn("band", F.floor(F.log("n_words") / F.lit(_BAND))), "apart", release=True)
    bands = wide.groupBy(*one, "band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.sum(F.col("n_words") + BINS).alias("words"), F.count(F.lit(1)).alias("members"))
    whole, beside = Window.partitionBy(*one), Window.partitionBy(*one).orderBy("band").rangeBetween(-1, 1)
    near = bands.select(*one, "band", "words", "members", F.min("least").over(beside).alias("least"), F.max("most").over(beside).alias("most")).filter("least < most")
    near = near.select(*one, "band", F.sum("members").over(whole).alias("members"), F.ceil(F.sum("words").over(whole) / F.lit(BLOCK)).cast("int").alias("blocks"))
    out = settle(wide.join(near, [*one, "band"]).select(*one, "id", "root", "blocks", "members"), "open", release=True)
    discard(wide)
    return out


def _by_rare_words(keyed: DataFrame, nodes: DataFrame, left: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Open members with buckets of rare words for the texts of those of more than CROWD blocks, and the ranks of words.

    Words are ranked by how many in these texts have the same first bits of a hash; only
    these 2^_SLOT counts come to the driver, and whatever they are, no pair is lost.
    """
    rank = np.zeros(1 << _SLOT, np.int32)
    part = settle(nodes.select("id", "k1", "k2", "n_words").join(left.filter(F.col("blocks") > CROWD).select("id", "root").distinct(), "id"), "crowd")
    if part.isEmpty():
        discard(part)
        return left, rank
    texts = maybe_in(keyed.select("k1", "k2", "text"), "k1", membership(part, "k1")).filter("_maybe")
    counts = texts.select("text").mapInArrow(_word_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    rank[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), np.iinfo(np.int32).max)
    rarest = texts.select("k1", "k2", "text").mapInArrow(partial(_rarest, rank=rank), "k1 long, k2 long, rarest array<long>").groupBy("k1", "k2").agg(F.first("rarest").alias("rarest"))
    rooted = settle(rarest.join(part, ["k1", "k2"]).select(F.lit(1).alias("rare"), F.explode("rarest").alias("one"), "id", "n_words", "root"), "rarest", release=True)
    rare = _apart(rooted)
    out = settle(left.filter(F.col("blocks") <= CROWD).unionByName(rare), "open", release=True)
    discard(left, part, rooted, rare)
    return out, rank


def _dealt(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """Open members with their histograms, in groups and order."""
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")
    dealt = left.select("rare", "one", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "root", "id")
    dealt = dealt.join(nodes.select("id", "n_words", "bins"), "id")
    return _grouped(dealt.select("rare", "one", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "root", "id", "n_words", "bins"))


def _grouped(members: DataFrame) -> DataFrame:
    return members.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "root")


def _bodies(keyed: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Table (id, text) of the texts with these ids."""
    part = settle(nodes.join(ids.distinct(), "id", "left_semi").select("id", "k1", "k2"), "paired")
    bodies = maybe_in(keyed.select("k1", "k2", "text"), "k1", membership(part, "k1")).filter("_maybe").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    out = settle(bodies.join(part, ["k1", "k2"]).select("id", "text"), "bodies", release=True)
    discard(part)
    return out


def _aligned(bodies: DataFrame, pairs: DataFrame, sharing: bool) -> DataFrame:
    """Table of the pairs whose texts align and, if asked, share a value."""
    full = pairs.join(bodies.toDF("a", "a_text"), "a").join(bodies.toDF("b", "b_text"), "b").select("a", "b", "a_text", "b_text")
    return settle(full.mapInArrow(partial(_verify, sharing=sharing), _PAIR), "links", release=True)


def texts_and_links(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Different texts (id, k1, k2, first_doc, copies, ...) and the verified links (a, b) between their ids.

    Links to hubs come first, then those to the likeliest partner in a
    text's largest bucket that these do not lead to. The texts of a bucket that are still apart and may align are aligned in
    their bucket until all that align are linked, so classes are those of all pairs in
    all buckets.
    """
    ship(docs.sparkSession)
    keyed = docs.filter(F.col(text).isNotNull()).select(*text_key(text), F.col(text).alias("text"), F.col(key).alias("doc"))
    schema = T.StructType().add("k1", "long").add("k2", "long").add("n_words", "long").add("sketch", T.ArrayType(T.LongType())).add("bins", "binary").add("doc", keyed.schema["doc"].dataType)
    rows = keyed.mapInArrow(_sketches, schema)
    texts = rows.groupBy("k1", "k2").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n_words", "sketch", "bins")))
    nodes = settle(texts.withColumn("id", F.monotonically_increasing_id()), "texts", release=True)
    values = nodes.select("id", F.explode("sketch").alias("one"))
    first = values.groupBy("one").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = settle(values.join(first, "one").withColumn("rare", F.lit(0)), "buckets", release=True)
    both = F.explode(F.array("a", "b")).alias("id")
    pairs, links = _hubs(nodes, member), None
    for last in (False, True):
        bodies = _bodies(keyed, nodes, pairs.select(both))
        found = _aligned(bodies, pairs, sharing=last)
        found = found if links is None else settle(links.unionByName(found), "links", release=True)
        left = _open(nodes, member, found)
        discard(*(t for t in (pairs, bodies, member, links) if t is not None))
        member, links = left, found
        if not last:
            member, rank = _by_rare_words(keyed, nodes, left)
            # Each text in the largest of its open buckets; the others have their turn below.
            large = member.groupBy("id").agg(F.max_by(F.struct("rare", "one", "root", "blocks"), F.struct("members", "rare", "one")).alias("m")).select("id", "m.*")
            best = _dealt(nodes, large).mapInArrow(_likeliest, _FOUND).groupBy("a").agg(F.min_by("b", F.struct("least", "b")).alias("b"))
            pairs = settle(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "likeliest", release=True)
    rest = settle(_dealt(nodes, member).mapInArrow(_partnered, _MEMBER), "rest", release=True)
    bodies = _bodies(keyed, nodes, rest.select("id"))
    more = _grouped(rest.join(bodies, "id").select(*_MEMBER.names, "text")).mapInArrow(partial(_linked, rank=rank), _PAIR)
    every = settle(links.unionByName(more).distinct(), "links", release=True)
    discard(member, rest, bodies, links)
    return nodes, every


def _class_id(first: Column, k1: Column) -> Column:
    """The least id of a class; without any id a negative number from its text."""
    return F.coalesce(first.cast("long"), -1 - (k1.bitwiseAND(F.lit((1 << 62) - 1))))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k1, k2, class_id, class_size, copies, links, leader) of each different text.

    class_id is the least id in the class, class_size its number of rows, copies
    the rows with this very text, links the number of other texts that it was linked
    with to make its class, pairs that were linked already not being tried. leader marks the text with the least id (then hash) in its class.
    """
    nodes, links = texts_and_links(docs, text, key)
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.join(roots.join(degree, "node", "left").withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = settle(named.select("k1", "k2", "first_doc", "copies", "root", F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = F.min(F.struct(F.col("first_doc").isNull().alias("x"), F.col("first_doc").alias("first"), F.col("k1").alias("k")))
    whole = named.groupBy("root").agg(least.alias("m"), F.sum("copies").alias("class_size"))
    leader = (F.col("m.k") == F.col("k1")) & F.col("m.first").eqNullSafe(F.col("first_doc"))
    out = named.join(whole, "root").select("k1", "k2", _class_id(F.col("m.first"), F.col("m.k")).alias("class_id"), "class_size", "copies", "links", leader.alias("leader"))
    out = settle(out, "classes")
    discard(nodes, links, named)
    return out


def label(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id, class_size, copies, links), one row per row of ``docs``.

    Texts that are equal are one class, also empty ones; those of fewer words than
    SHINGLE - 1 only if their words are equal. Texts count whole, however long. A null
    text is in a class of its own, named by its id (null without one). Repeated rows are
    copies of each other. Other columns are not read, and an empty table gives no rows.
    """
    found = classes(docs, text, key)
    rows = docs.select(F.col(key), F.col(text).isNull().alias("_none"), *text_key(text))
    known = rows.filter("not _none").join(found, ["k1", "k2"]).select(key, "class_id", "class_size", "copies", "links")
    none = rows.filter("_none").select(key, F.col(key).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return known.unionByName(none)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, that with the least id, with its columns; rows with null texts all stay.

    Of rows that repeat id and text one stays. Columns of any name stay as they are;
    an empty table gives an empty one.
    """
    found = classes(docs, text, key)
    row = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.filter(F.col(text).isNotNull()).select(*text_key(text), F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("id")).alias("o"), row.alias("row"))
    leaders = found.filter("leader").select("k1", "k2")
    best = keyed.groupBy("k1", "k2").agg(F.min_by("row", "o").alias("row")).join(leaders, ["k1", "k2"], "left_semi")
    return best.select("row.*").unionByName(docs.filter(F.col(text).isNull()))
