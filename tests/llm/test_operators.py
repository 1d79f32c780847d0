"""Small cases, edge rows and brute force for the operators of siltstone.llm."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import decontam, hamming, kernel, lines, mixing, near_dup, pii, quality, sharding, substring, toxicity
from siltstone.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, k1 string, items string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = []
    for i in range(80):
        body = words(rng, rng.randint(1, 160))
        if i % 7 == 0:
            body = body[:20] + passage + body[20:]
        rows.append((i, " ".join(body)))
    for i in range(80, 100):
        body = rows[i - 80][1].split()
        body[len(body) // 2] = "changed"
        rows.append((i, " ".join(body)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (None, rows[4][1]), (None, None), (102, None), (103, ""), (104, ""), (105, " \n\t "), (106, "one two three"), (107, "one two three"), (108, "De " * 3000)]
    rows.append((109, "x" * 200_000))
    return [(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 3}", None, "a", "b", "c", "d") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# kernel


def test_words_and_grams_follow_texts():
    texts = ["a bb  ccc", "", "dd", "bb ccc a"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = kernel.find_words(np.frombuffer(raw, np.uint8), offsets, kernel.NON_SPACE)
    assert [found.text(i).decode() for i in range(len(found))] == [w for t in texts for w in t.split()]
    assert found.count.tolist() == [3, 0, 1, 3]
    h, g = found.hashes(), kernel.grams(found.hashes(), 2)
    assert h[1] == h[4] and h[2] == h[5] and h[0] == h[6] and len(set(h.tolist())) == 4
    assert g[1] == g[4] and len(set(g.tolist())) == 5


# op3


def test_pii_checks_and_context():
    text = "Mail a.b@c.de, call +1 (555) 555-0199; card 4539 1488 0343 6467, not 4539 1488 0343 6468. ip 10.0.0.255 or 10.0.0.256."
    kinds = [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]
    assert kinds == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (555) 555-0199")]
    assert [s[0] for s in pii.spans("iban GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert not [s for s in pii.spans("GB82 WEST 1234 5698 7654 33") if s[0] == "iban"]
    assert [s[0] for s in pii.spans("my ssn is 536-22-1234")] == ["ssn"] and not pii.spans("code 536-22-1234")
    assert pii.spans(None) == pii.spans("") == []


@pytest.mark.parametrize("number", ["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["", " BIC: X", " The bank", " 2 days", " I said", ", ok", " and DE89 3704 0044 0532 0130 00", "\n"])
def test_pii_account_numbers_end_where_their_check_does(number, after):
    text = f"to {number}{after}"
    found = [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"]
    assert found == [number, *(["DE89 3704 0044 0532 0130 00"] if "DE89" in after else [])]
    assert not [s for s in pii.spans(f"to {number}7{after}") + pii.spans(f"to x{number}{after}") if s[0] == "iban" and s[1] < len(number)]


def test_pii_account_numbers_are_linear():
    assert not [s for s in pii.spans("GB29 " * 60_000 + "A" * 300_000) if s[0] == "iban"]


@pytest.mark.parametrize("secret", ["a1" * 16, "a" * 60 + "1", "b7" * 80, "k" * 500 + "9"])
def test_pii_secrets_of_any_length(secret):
    assert [s[:3] for s in pii.spans(f"token {secret} ok")] == [("secret", 6, 6 + len(secret))]
    assert not pii.spans("token " + "k" * len(secret)) and not pii.spans(f"so {secret}")


@pytest.mark.parametrize(
    ("run", "near", "far"),
    [
        ("AKIA" + "Q7" * 8, 20, 20), ("ghp_" + "a" * 23 + "4", 28, 28), ("a1b2c3d4e5f6g7h8", 16, 0), ("abcdefghijklmn12", 0, 0), ("some-words-and-12345", 0, 0),
        ("Ab1+" * 10 + "==", 42, 0), ("Ab1/" * 10, 40, 0), ("path/to/some/file/of/the/tree/12345", 0, 0), ("1234567890123456", 0, 0),
    ],
)
def test_pii_shorter_secrets_and_known_forms(run, near, far):
    size = lambda text: sum(b - a for k, a, b, _ in pii.spans(text) if k == "secret")
    assert (size(f"the token {run} 1 ok"), size(f"so {run} 1 ok")) == (near, far)


def test_pii_account_numbers_in_lower_case():
    assert [s[:3] for s in pii.spans("to gb82west12345698765432 now")] == [("iban", 3, 25)]
    assert not pii.spans("to gb82west12345698765433 now") and not pii.spans("id42 some words follow here and there")


def test_pii_query_has_the_counts_and_digests_of_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: max(map(int, m.split("."))) <= 255),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(pii.digits(m)) <= 19 and pii.luhn(pii.digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(pii.digits(m)) <= 15),
    }
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        base = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}
        every = ",".join(x for k in kinds for x in base[k])
        assert [got[doc][f"n_{k}"] for k in kinds] == [len(base[k]) for k in kinds]
        assert got[doc]["base_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert got[doc]["spans"].split(",")[: sum(map(len, base.values()))] == (every.split(",") if every else [])


def test_toxicity_sample_is_bound_by_hash_before_it_is_collected(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('ab ', 30) AS text", "CAST(id % 2 AS INT) AS toxic")
    found = toxicity.sample(rows.select("doc_id", F.concat("text", F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("text")), rows.select("doc_id", "toxic")).to_pylist()
    ids = {v: sorted(int(r["text"][-3:]) for r in found if r["label"] == v) for v in (0, 1)}
    # Ten texts of 93 bytes a class, not those of least id.
    assert {v: len(x) for v, x in ids.items()} == {0: 10, 1: 10} and max(ids[0]) > 100 and max(ids[1]) > 100
    # A text above the bound alone is still one to learn from.
    assert toxicity.sample(spark.createDataFrame([(1, "x " * 900)], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).num_rows == 1


def test_pii_matches_plain_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@@..--++ 0123456789014(),é\n") for _ in range(rng.randint(0, 60)))
        plain = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        plain += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        plain += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := pii.digits(m.group())) <= 19 and pii.luhn(d)]
        plain += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(pii.digits(m.group())) <= 15]
        assert [s[:3] for s in pii.spans(t) if s[0] in pii.BASE] == plain


def test_pii_long_runs_are_linear():
    assert pii.spans("1" * 300_000) == [] and pii.spans("a" * 300_000 + "@") == [] and pii.spans("1." * 2 + "0" * 9000) == []


def test_pii_keeps_rows_and_redacts(docs, empty):
    out = pii.find(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "pii"]
    assert pii.find(empty).count() == 0
    spark = docs.sparkSession
    assert pii.redact(spark.createDataFrame([("hi a@b.co!",), (None,)], "text string")).collect()[0][0] == "hi [email]!"


# op4


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        whole = sum(w[s] for s in left)
        over = [s for s in left if total * w[s] / whole > 2 * sizes[s]]
        if not over:
            return out | {s: total * w[s] / whole for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
            left.remove(s)
    return out


def test_mix_meets_targets(docs, corpus):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes, taken, want, largest = defaultdict(int), defaultdict(int), {}, 0
    by_id = {}
    for r in rows:
        by_id.setdefault((r["doc_id"], r["size"]), []).append(r)
    for row in corpus:
        sizes[row[3]] += len((row[1] or "").split())
    for row in corpus:
        r = by_id[row[0], len((row[1] or "").split())][0]
        assert r["source_size"] == sizes[row[3]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[row[3]] += r["taken"]
        want[row[3]] = r["target"]
    plain = plain_targets(sizes)
    for s in sizes:
        assert want[s] == pytest.approx(plain[s])
        assert plain[s] * 0.9 - 5 <= taken[s] <= plain[s] + 1e-6
    assert pairs(mixing.mix(docs), "doc_id", "taken") == pairs(mixing.mix(docs.repartition(7)), "doc_id", "taken")


def test_mixed_repeats_rows(docs, empty):
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert max(copies.values()) <= 2
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# op5


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_banded_distance_is_exact():
    rng = random.Random(3)
    for _ in range(4000):
        a = [rng.randint(0, rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 14))]
        b = a[:] if rng.random() < 0.7 else [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            b = b[:i] + [rng.randint(0, 9)] * rng.randint(0, 2) + b[i + rng.randint(0, 1) :]
        most = rng.randint(0, 8)
        assert near_dup.distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(plain_distance(a, b), most + 1)


def test_near_duplicates_equal_brute_force(docs, corpus):
    texts = sorted({t for _, t, *_ in corpus if t is not None})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    split = {t: t.split() for t in texts}
    for x, a in enumerate(texts):
        for b in texts[:x]:
            longest = max(len(split[a]), len(split[b]))
            short = min(len(split[a]), len(split[b]))
            if split[a] == split[b] and longest:
                root[find(a)] = find(b)
            elif short >= 5 and short >= 0.8 * longest and len(set(zip(*(split[a][k:] for k in range(5)))) & set(zip(*(split[b][k:] for k in range(5))))) and plain_distance(split[a], split[b]) <= 0.2 * longest:
                root[find(a)] = find(b)
    want, got = defaultdict(list), defaultdict(list)
    for i, t, *_ in corpus:
        if t is not None:
            want[find(t)].append(i)
    rows = near_dup.label(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        got[r["class_id"]].append(r["doc_id"])
    none = {102, None}
    sort = lambda groups: sorted((sorted(g, key=str) for g in groups if not set(g) <= none), key=str)
    assert sort(want.values()) == sort(got.values())
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.filter("text is not null").count() == len(want) and kept.filter("text is null").count() == 2


def test_near_duplicates_inside_a_family(spark):
    """Planted pairs among dissimilar variants of one text: classes are those of all aligned pairs of all buckets."""
    rng = random.Random(11)

    def variant(text, share, tag):
        at = set(rng.sample(range(len(text)), round(len(text) * share)))
        return [f"{tag}x{k}" if k in at else w for k, w in enumerate(text)]

    rows, planted = [], []
    for f in range(6):
        base = [f"b{f}w{k}" for k in range(250)]
        rows += [(f * 1000 + i, " ".join(variant(base, 0.16, f"f{f}n{i}"))) for i in range(100)]
        planted.append((f * 1000 + 900, f * 1000 + 901))
        rows += [(i, " ".join(variant(base, 0.08, f"p{i}"))) for i in planted[-1]]
    raw = "".join(t for _, t in rows).encode()
    found = kernel.find_words(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t) for _, t in rows)]), kernel.NON_SPACE)
    hashes, sketch, buckets = found.hashes(), near_dup.sketch(found), defaultdict(list)
    for d in range(len(rows)):
        for x in set(sketch[d].tolist()) - {0}:
            buckets[x].append(d)
    root = list(range(len(rows)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    own = [hashes[found.bounds[d] : found.bounds[d + 1]] for d in range(len(rows))]
    for a, b in {(a, b) for g in buckets.values() for a in g for b in g if b < a}:
        if near_dup.similar(own[a], own[b]):
            root[find(a)] = find(b)
    want, got = defaultdict(set), defaultdict(set)
    for d, (i, _) in enumerate(rows):
        want[find(d)].add(i)
    for r in near_dup.label(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert sum(set(p) in want.values() for p in planted) >= 4
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("size", [*((n, n) for n in range(5, 16)), (4, 5), (8, 10), (20, 20), (30, 30), (50, 50), (64, 64), (65, 65), (64, 66), (60, 60), (99, 102), (105, 105), (250, 250), (300, 300), (1000, 1000)])
def test_sketches_agree_at_the_threshold(size):
    """Of pairs with a fifth of the words changed here and there, over 0.99 share a value, 0.95 of those of less than 20 words."""
    rng, texts = random.Random(size[1]), []
    for p in range(500):
        at = set(rng.sample(range(size[0]), size[1] // 5 - (size[1] - size[0])))
        texts += [" ".join(f"{p}w{k}" for k in range(size[0])), " ".join([f"{p}x{k}" if k in at else f"{p}w{k}" for k in range(size[0])] + [f"{p}y{k}" for k in range(size[1] - size[0])])]
    found = kernel.find_words(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), kernel.NON_SPACE)
    hashes = found.hashes()
    assert near_dup.similar(hashes[: found.bounds[1]], hashes[found.bounds[1] : found.bounds[2]])
    values = [set(v.tolist()) - {0} for v in near_dup.sketch(found)]
    share = np.mean([not a.isdisjoint(b) for a, b in zip(values[::2], values[1::2], strict=True)])
    assert share > (0.99 if size[0] >= 20 else 0.95)


def test_sketches_do_not_depend_on_the_texts_beside():
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randint(1, 40))) for _ in range(400)]
    split = lambda ts: kernel.find_words(np.frombuffer("".join(ts).encode(), np.uint8), np.cumsum([0, *map(len, ts)]), kernel.NON_SPACE)
    together = near_dup.sketch(split(texts))
    assert all((near_dup.sketch(split([t]))[0] == row).all() for t, row in zip(texts, together, strict=True))


def test_sketch_values_keep_the_order():
    texts = ["a b c d e f g h", "e f g h a b c d"]
    found = kernel.find_words(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), kernel.NON_SPACE)
    _, start, pool = near_dup._pool(found)
    assert start.tolist() == [0, 6] and pool[0] == pool[6] and pool[5] == pool[11] and len(set(pool.tolist())) == 10
    # Values of the long shingles; those of two words agree where these keep their order.
    long = near_dup.HASHES * near_dup.PICKS * (near_dup.PICKS - 1) // 2
    one, two = (set(v[:long].tolist()) - {0} for v in near_dup.sketch(found))
    assert one and two and one.isdisjoint(two)
    texts = ["a b c d", "c d a b"]
    found = kernel.find_words(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), kernel.NON_SPACE)
    one, two = (set(v[long:].tolist()) - {0} for v in near_dup.sketch(found))
    assert one and two and one.isdisjoint(two)


def test_histograms_bound_the_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randint(0, 40) for _ in range(rng.randint(0, 4))]
        text = [" ".join(map(str, x)) for x in (a, b)]
        found = kernel.find_words(np.frombuffer("".join(text).encode(), np.uint8), np.cumsum([0, *map(len, text)]), kernel.NON_SPACE)
        bins = near_dup.histograms(found)
        assert near_dup.least_edits(bins[:1], bins[1:])[0] <= plain_distance(a, b)


def test_large_buckets_in_blocks_are_the_same(spark, docs, monkeypatch):
    once = pairs(near_dup.label(docs), "doc_id", "class_id", "class_size")
    monkeypatch.setattr(near_dup, "BLOCK", 800)
    monkeypatch.setattr(near_dup, "_TILE", 2)
    monkeypatch.setattr(near_dup, "_LANES", 3)
    monkeypatch.setattr(near_dup, "_TURN", 2)
    assert pairs(near_dup.label(docs), "doc_id", "class_id", "class_size") == once


def test_texts_that_align_share_a_rare_word():
    """Whatever the ranks; and a text's rare words do not depend on the texts beside."""
    rng, found = random.Random(5), 0
    split = lambda ts: kernel.find_words(np.frombuffer("".join(ts).encode(), np.uint8), np.cumsum([0, *map(len, ts)]), kernel.NON_SPACE)
    for k in range(1500):
        kinds = rng.choice([2, 6, 50])
        a = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 40))]
        b = a[:]
        for _ in range(rng.randint(0, len(a) // 5 + 1)):
            i = rng.randint(0, len(b))
            b = b[:i] + [f"z{rng.randrange(9)}"] * rng.randint(0, 2) + b[i + rng.randint(0, 1) :]
        both = split([" ".join(a), "", " ".join(b)])
        rank = np.random.default_rng(k).integers(0, 5, 1 << near_dup._SLOT)
        one, none, two = (set(w.tolist()) for w in near_dup.rare_words(both, rank))
        hashes, at = both.hashes(), both.bounds
        assert not none and set(near_dup.rare_words(split([" ".join(b)]), rank)[0].tolist()) == two
        if near_dup.similar(hashes[at[0] : at[1]], hashes[at[2] : at[3]]):
            found += 1
            assert one & two or not b
    assert found > 500


def test_crowds_by_rare_words_are_the_same(docs, monkeypatch):
    once = pairs(near_dup.label(docs), "doc_id", "class_id", "class_size")
    monkeypatch.setattr(near_dup, "CROWD", 0)
    assert pairs(near_dup.label(docs), "doc_id", "class_id", "class_size") == once


def _dealt_rows(monkeypatch) -> list[int]:
    rows, deal = [], near_dup._dealt
    monkeypatch.setattr(near_dup, "_dealt", lambda *a: rows.append((out := deal(*a)).count()) or out)
    return rows


def test_rows_dealt_do_not_grow_with_the_square_of_a_bucket(spark, monkeypatch):
    """Texts with one line in common and little else, of which two are alike."""
    monkeypatch.setattr(near_dup, "BLOCK", 2000)
    rows, line = _dealt_rows(monkeypatch), " ".join(f"line{k}" for k in range(12))
    for n in (60, 120, 240):
        rng = random.Random(n)
        own = [[f"v{rng.randrange(20000)}" for _ in range(30)] for _ in range(n)]
        own[7] = [*own[3][:13], "other", *own[3][14:]]
        texts = spark.createDataFrame([(i, f"{line}\n{' '.join(w)}") for i, w in enumerate(own)], "doc_id long, text string")
        size = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dup.label(texts).collect()}
        assert size[3] == size[7] == (3, 2) and sum(s == 1 for _, s in size.values()) == n - 2
        rows.append(-n)
    done = [sum(rows[a + 1 : b]) for a, b in zip([-1, *(k for k, r in enumerate(rows) if r < 0)], (k for k, r in enumerate(rows) if r < 0), strict=False)]
    assert done[1] <= 2 * done[0] and done[2] <= 2 * done[1], done


def test_buckets_of_the_same_members_are_dealt_once(spark, monkeypatch):
    """Two texts with 120 words in common and 120 apart share many values; their pair is one group of two members, in either step."""
    rows = _dealt_rows(monkeypatch)
    same = " ".join(f"w{k}" for k in range(120))
    texts = [(i, same + " " + " ".join(f"{i}x{k}" for k in range(120))) for i in range(2)]
    raw = "".join(t for _, t in texts).encode()
    one, two = near_dup.sketch(kernel.find_words(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t) for _, t in texts)]), kernel.NON_SPACE))
    assert len(set(one.tolist()) & set(two.tolist()) - {0}) > 2
    found = near_dup.label(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["class_size"] for r in found} == {1} and rows == [2, 2]


def test_near_duplicates_of_nothing(empty):
    assert near_dup.label(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in near_dup.components(links).collect()}
    assert set(found[i] for i in range(41)) == {0} and found[101] == 100


# op6

BENCH = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "Short Item!"), (3, ""), (4, None), (None, "null id item"), (10, "W1-w2 w3 w4 w5 w6 w7 w8 w9 w10")]


def test_decontaminate_small(spark, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = ["x W1, w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 y", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "a short-item b SHORT item", None, "", "null id item"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(rows, bench).collect()}
    assert got == {0: (13, 11, ["1", "10"]), 1: (9, 0, []), 2: (6, 4, ["2"]), 3: (0, 0, []), 4: (0, 0, []), 5: (3, 3, ["null"])}
    assert {r["doc_id"] for r in decontam.decontaminate(rows, bench).collect()} == {1, 3, 4}
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(rows, bench, remove="spans").collect()}
    assert spans[0] == "x  y" and spans[2] == "a  b " and spans[3] is None
    assert decontam.scan(empty, bench).count() == 0
    assert decontam.scan(rows, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontaminate_in_blocks_is_the_same(spark, docs, corpus, monkeypatch):
    items = [(i, " ".join(t.split()[3:40])) for i, t, *_ in corpus if t and i is not None][:30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = pairs(decontam.scan(docs, bench).selectExpr("doc_id", "n_words", "n_hit", "array_join(items, ',') i"), "doc_id", "n_words", "n_hit", "i")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    many = decontam.scan(docs, bench)
    assert pairs(many.selectExpr("doc_id", "n_words", "n_hit", "array_join(items, ',') i"), "doc_id", "n_words", "n_hit", "i") == once
    assert any(k[2] for k in once)


def test_decontaminate_keeps_the_values_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "clean text", "mine", 7.5, 3)], "doc_id long, text string, items string, cover double, n_hit int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for remove in ("documents", "spans"):
        out = decontam.decontaminate(rows, bench, remove=remove)
        assert out.schema == rows.schema and out.collect() == rows.collect()


def test_decontaminate_in_many_blocks_holds_one(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 12, 5000))) for i in range(60)]
    rows = [(i, " ".join(words(rng, 30, 5000) + items[i % 60][1].split() + words(rng, 5, 5000)), f"k{i}") for i in range(90)] + [(90, None, "k"), (91, "", "k"), (1, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = pairs(decontam.scan(df, bench).selectExpr("doc_id", "_k1", "n_words", "n_hit", "array_join(items, ',') i", "hex(cover) c"), "doc_id", "_k1", "n_words", "n_hit", "i", "c")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    made = []
    real = decontam._index

    def index(*args):
        made.append(args[2])
        return real(*args)

    monkeypatch.setattr(decontam, "_index", index)
    many = pairs(decontam.scan(df, bench).selectExpr("doc_id", "_k1", "n_words", "n_hit", "array_join(items, ',') i", "hex(cover) c"), "doc_id", "_k1", "n_words", "n_hit", "i", "c")
    assert many == once and len(made) > 10 and sum(n for k, n in once.items() if k[3] == 12) == 90


# op7 and op10


def labelled(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        body = words(rng, rng.randint(30, 120), 300)
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["nasty", "vile", "rotten"]))
        if bad:
            body = [w.upper() + "!!" for w in body[:8]] * 6
            if toxic:
                body[5] = "VILE"
        rows.append((i, " ".join(body)))
        if i < 500:
            marks.append((i, int(not bad), int(toxic)))
    marks += [(5, None, None), (None, 1, 1), (7, 1, 0)]
    rows += [(900, None), (901, ""), (None, "w1 w2"), (902, "a " * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_hold_out(spark, kind):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in kind.classify(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got.values())
    truth = (lambda i: i % 4 == 0) if kind is toxicity else (lambda i: i % 5 != 0)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == truth(i) for i in held)
    assert len(held) > 60 and right / len(held) >= 0.95
    # Held-out labels change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) toxic")
    again = {r["doc_id"]: r["score"] for r in kind.classify(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-9) for i in got)
    nothing = kind.classify(docs, labels.limit(0)).collect()
    assert len(nothing) == 604 and len({r["score"] for r in nothing}) == 1
    assert kind.classify(docs.limit(0), labels).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    w = {"attention": rng.normal(size=16), "out": rng.normal(size=16), "out_bias": np.zeros(1)}
    for side in "lr":
        w |= {f"{side}_in": rng.normal(size=(8, 24)), f"{side}_rec": rng.normal(size=(8, 24)), f"{side}_bias": rng.normal(size=24)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    x, mask = rng.normal(size=(5, 3, 8)).astype(np.float32), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    label, weight = np.array([1, 0, 1.0]), np.ones(3)
    _, grad, dx = toxicity.gradients(w, x, mask, label, weight)
    for name, at in (("l_in", (2, 5)), ("r_rec", (3, 20)), ("l_rec", (1, 2)), ("attention", (4,)), ("r_bias", (17,)), ("out", (9,))):
        e = 1e-2
        w[name][at] += e
        up = toxicity.gradients(w, x, mask, label, weight)[0]
        w[name][at] -= 2 * e
        low = toxicity.gradients(w, x, mask, label, weight)[0]
        w[name][at] += e
        assert grad[name][at] == pytest.approx((up - low) / (2 * e), abs=2e-2)
    assert not dx[3, 1].any()


def plain_tokens(text):
    """(whole, runs) of the tokens of a text: runs of letters, digits and what is not ASCII, cut after each 24 runs of four characters."""
    out = []
    for word in re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if c.isascii() else c for c in text)):
        runs = [word[i : i + 4] for i in range(max(1, len(word) - 3))]
        for a in range(0, len(runs), 24):
            part = runs[a : a + 24]
            out.append((word[a : a + len(part) - 1 + len(part[-1])], part))
    return out


@pytest.mark.parametrize("texts", [["", "Ab cétés x", "中文字符串" * 20, "q" * 27 + " " + "r" * 28, "!?"], ["", ""], ["a" * 1000]])
def test_tokens_hold_every_character(texts):
    import pyarrow as pa

    for _, _, data, offsets in kernel.slices(pa.array(texts)):
        got = toxicity.tokens(kernel.find_words(data, offsets, kernel.ALNUM, kernel.LOWER))
    want = [plain_tokens(t) for t in texts]
    assert np.diff(got.bounds).tolist() == [len(t) for t in want]
    flat = [t for doc in want for t in doc]
    assert np.diff(got.edge).tolist() == [len(runs) for _, runs in flat]
    # Equal strings have equal hashes, unlike ones unlike.
    for hashes, names in ((got.word, [w for w, _ in flat]), (got.gram, [r for _, runs in flat for r in runs])):
        assert len(hashes) == len(names) and len(set(zip(hashes.tolist(), names))) == len(set(names)) == len(set(hashes.tolist()))


def test_scores_equal_a_plain_network():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randint(5, 150), 60) + (["vile"] if i % 2 else [])) for i in range(60)] + ["", "x" * 500]
    net = toxicity.train(pa.array(texts), np.array([i % 2 for i in range(60)] + [0, 0]), epochs=1)
    w, row = net.weights, lambda h: w["embedding"][net.lookup(np.array([h], kernel.U))[0]].astype(float)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(side, xs):
        h, out = np.zeros(8), []
        for x in xs:
            g, a = x @ w[f"{side}_in"] + w[f"{side}_bias"], h @ w[f"{side}_rec"]
            z, r = sig(g[:8] + a[:8]), sig(g[8:16] + a[8:16])
            n = np.tanh(g[16:] + r * a[16:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    for _, _, data, offsets in kernel.slices(pa.array(texts)):
        got = net.score(data, offsets)
        found = toxicity.tokens(kernel.find_words(data, offsets, kernel.ALNUM, kernel.LOWER))
        for d in range(0, len(texts), 7):
            a, b = found.bounds[d], found.bounds[d + 1]
            xs = [row(found.word[t]) + sum(map(row, found.gram[found.edge[t] : found.edge[t + 1]])) / np.sqrt(found.edge[t + 1] - found.edge[t]) for t in range(a, b)]
            best = -30.0
            for s in sorted({max(0, min(s, len(xs) - 64)) for s in range(0, max(1, len(xs) - 16), 48)}):
                part = xs[s : s + 64]
                h = [np.concatenate(p) for p in zip(states("l", part), states("r", part[::-1])[::-1])]
                e = np.array([v @ w["attention"] for v in h])
                share = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(h) else e
                best = max(best, float(sum((s * v for s, v in zip(share, h)), np.zeros(16)) @ w["out"] + w["out_bias"][0]))
            assert got[d] == pytest.approx(sig(best), abs=1e-4)


def test_toxicity_of_spelling_and_order(spark):
    """Unseen words that hide a known one in their middle are caught, in a long unspaced run too."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        body = words(rng, rng.randint(30, 90), 300)
        if i % 3 == 0:
            hidden = "".join(rng.choice("abcdefgh") for _ in range(8)) + "loathsome" + "".join(rng.choice("abcdefgh") for _ in range(8))
            for _ in range(3):
                body.insert(rng.randrange(len(body)), hidden)
        rows.append((i, " ".join(body), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == t for i, t in held) / len(held) >= 0.95


def test_quality_scores_equal_plain_densities(spark):
    """Scores against log densities of Gaussians by numpy's solver, covariances from the rows themselves; repeated rows alike."""
    docs, labels = labelled(spark)
    known = quality.with_statistics(docs.union(docs.filter("doc_id < 3")))
    marks = quality.training_labels(labels, "quality")
    model = quality.fit(known.join(marks, "doc_id"), "quality")
    rows = [(r["doc_id"], np.array(r["statistics"]), r["s"]) for r in known.withColumn("s", model.score(known["statistics"])).collect()]
    truth = {r["doc_id"]: r["quality"] for r in marks.collect()}
    part = [np.array([x for i, x, _ in rows if truth.get(i) == k]) for k in (0, 1)]
    size, n = len(quality.FEATURES), [len(p) for p in part]
    inside = [np.cov(p, rowvar=False, bias=True) for p in part]
    pooled = (n[0] * inside[0] + n[1] * inside[1]) / sum(n) + quality.RIDGE * np.eye(size)
    spread = []
    for k in (0, 1):
        lean = min(1.0, quality.TO_POOLED + size / (size + n[k]))
        c = (1 - lean) * inside[k] + lean * pooled
        spread.append(c - quality.TO_DIAGONAL * (c - np.diag(np.diag(c))) + quality.RIDGE * np.eye(size))

    def density(k, x):
        d = x - part[k].mean(0)
        return -0.5 * (d @ np.linalg.solve(spread[k], d) + np.linalg.slogdet(spread[k])[1])

    by_id = defaultdict(set)
    for i, x, s in rows:
        odds = density(1, x) - density(0, x) + np.log((n[1] + 1) / (n[0] + 1))
        assert s == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -30, 30))), abs=1e-6)
        by_id[i].add(s)
    assert len(rows) == 607 and all(len(by_id[i]) == 1 for i in range(3))


def test_windows_overlap_and_cover():
    bounds = np.array([0, 0, 10, 10 + 64, 74 + 200])
    text, first, size = toxicity.windows(bounds)
    assert Counter(text.tolist()) == {0: 1, 1: 1, 2: 1, 3: 4}
    seen = np.zeros(274, bool)
    for a, n in zip(first, size):
        seen[a : a + n] = True
    assert seen.all()


# op8


def test_sharding_moves_few_keys(docs, empty):
    assert Counter(sharding.lookup(3, 7)).most_common(1)[0][1] <= 3
    before, after = np.array(sharding.lookup(10, 65537)), np.array(sharding.lookup(11, 65537))
    assert max(Counter(before.tolist()).values()) - min(Counter(before.tolist()).values()) <= 1
    assert (before != after).mean() < 0.25
    out = sharding.place(docs)
    assert out.count() == docs.count() and out.columns == [*[c for c in docs.columns if c != "shard"], "slot", "shard"]
    for r in out.collect():
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.lookup()[slot])
    assert sharding.place(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup(4, 8)


# op9


def test_substring_equals_brute_force(docs, corpus, empty):
    n, seen = 35, Counter()
    split = [(t or "").split() for _, t, *_ in corpus]
    for w in split:
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = Counter()
    for (i, *_), w in zip(corpus, split):
        gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        want[i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    out = substring.remove_repeats(docs)
    assert pairs(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert substring.remove_repeats(empty).count() == 0


# op1


def plain_chunks(ls):
    """(first line, last line) of the chunks of both kinds."""
    out, h = set(), [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
    for kind in (0, 1):
        at = 0
        for i in range(1, len(ls)):
            if (h[i - 1] * 1000003 + h[i]) % 2147483647 % 2 == kind:
                out.add((at, i))
                at = i - 1
        if len(ls) > 1:
            out.add((at, len(ls) - 1))
    return out


def plain_lines(rows):
    """Counter of (id, lines, removed lines, sha256 of the kept lines)."""
    first, gone, want = {}, defaultdict(set), Counter()
    place = lambda i, a: ((i is None, -1 if i is None else i), a)
    for turn in (0, 1):
        for i, t in rows:
            ls = t.split("\n") if t is not None else []
            for a, b in plain_chunks(ls):
                body = "\n".join(ls[a : b + 1])
                if body.strip() and turn == 0:
                    first[body] = min(first.get(body, place(1 << 60, 0)), place(i, a))
                elif body.strip() and first[body] != place(i, a):
                    gone[i, t] |= set(range(a, b + 1))
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(ls) if k not in gone[i, t]]
        want[i, len(ls), len(gone[i, t]), sha("\n".join(kept))] += 1
    return want


@pytest.mark.parametrize("size,least", [(4, 0.6), (8, 0.95), (12, 0.97), (40, 0.99)])
def test_lines_of_repeated_passages_are_found(size, least):
    """Passages between lines of their own, in two texts each."""
    rng = random.Random(size)
    found = []
    for _ in range(300):
        passage = [f"p{rng.random()}" for _ in range(size)]
        texts = [[f"o{rng.random()}" for _ in range(7)] + passage + [f"o{rng.random()}" for _ in range(7)] for _ in range(2)]
        bodies = [{tuple(t[a : b + 1]): (a, b) for a, b in plain_chunks(t)} for t in texts]
        lines_ = {k for body in bodies[0].keys() & bodies[1].keys() for k in range(bodies[1][body][0], bodies[1][body][1] + 1)}
        found.append(len(lines_) / size)
    assert np.mean(found) >= least


def test_lines_of_copies_are_all_found(spark):
    rows = [(i, "\n".join(f"{i // 2} line {k}" for k in range(1 + i // 2))) for i in range(40)]
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_removed"] == (got[i]["n_lines"] if i % 2 and i > 1 else 0) for i in got)


def test_lines_of_unlike_chunks_with_one_hash_stay(spark, monkeypatch):
    """With hashes of five values, only chunks of equal bytes go."""

    rng = random.Random(3)
    rows = [(i, "\n".join(f"l{rng.randrange(6)}" for _ in range(rng.randint(1, 8)))) for i in range(60)]
    want, real = plain_lines(rows), lines.chunks
    fold = lambda text, bodies: F.transform(real(text, bodies), lambda c: c.withField("h", F.pmod(c["h"], F.lit(5))))
    monkeypatch.setattr(lines, "chunks", fold)
    assert pairs(lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_removed", "kept_sha256") == want


def test_lines_keep_the_values_of_clashing_columns(spark):
    rows = [(1, "a\nb\nc", "x", 5), (2, "a\nb\nc", "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string, _maybe int")
    got = sorted(tuple(r[c] for c in ("doc_id", "text", "_t", "_maybe", "n_removed")) for r in lines.dedup(df).collect())
    assert got == [(*rows[0], 0), (*rows[1], 3)]


def test_lines_equal_brute_force(spark, empty):
    rng = random.Random(4)
    common = [f"line {k}" for k in range(12)]
    rows = []
    for i in range(60):
        body = [f"own {rng.random()}" for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, len(body))
        rows.append((i, "\n".join(body[:at] + (common[: rng.randint(2, 12)] if i % 3 == 0 else []) + body[at:])))
    rows += [(200, rows[1][1]), (200, rows[1][1]), (None, rows[1][1]), (201, None), (202, ""), (203, "\n\n\n\n\n"), (204, "\n\n\n\n\n"), (205, "x\n" * 4000)]

    want = plain_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lines.dedup(docs)
    assert pairs(out, "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want) and lines.dedup(empty).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op2


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 64)).astype(np.float32)
    vectors[100:140] = vectors[100]
    vectors[300:340] = vectors[40] * np.where(rng.random((40, 64)) < 0.1, -1, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(40, vectors[40].tolist()), (None, vectors[1].tolist()), (900, None), (920, []), (940, [None, 1.0])]
    df = spark.createDataFrame(rows, T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())))
    code = {}
    base = [(i, tuple((list(v) + [0.0] * 64)[:64])) for i, v in rows if i is not None and v is not None]
    bits = np.array([[(x or 0) > 0 for x in v] for _, v in base])
    ids = np.array([i for i, _ in base])
    want = set()
    for q in sorted({i for i, _ in base if i % 20 == 0}):
        far = (bits != bits[list(ids).index(q)]).sum(1)
        order = np.lexsort((ids, far))[:10]
        want |= {(q, r + 1, int(ids[o]), int(far[o])) for r, o in enumerate(order)}
    monkeypatch.setattr(hamming, "PART", 200)
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want
    monkeypatch.setattr(hamming, "BLOCK", 9)
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want
    assert hamming.top_k(df.limit(0)).count() == 0


def test_top_k_refuses_longer_vectors(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a vector has 65 elements"):
        hamming.codes(df).collect()
    assert hamming.codes(df.limit(1)).collect()[0]["code"] == -1
