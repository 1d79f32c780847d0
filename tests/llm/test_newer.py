"""Secrets in layers, fill-in-the-middle ropes and hard negatives: round trips, brute force, edge rows."""

import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from siltstone.llm import infill, negatives, secrets

DOCS = "doc_id long, text string, secrets string, n string, form string, kind string, q string"
SECRET = 'password = "abcDEF123456+/=xyz'


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "own", "x", "y", "z", None) for i, t in texts], DOCS)


# op11


def plain_base(text):
    """The base kinds as their patterns say them, without any of the operator's code."""
    out = []
    for i, (pattern, least, flags, group) in enumerate(
        (
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A, 2),
            (r"AKIA[A-Z0-9]+", 18, 0, 0),
            (r"[0-9a-f]+", 16, 0, 0),
        )
    ):
        out += [(m.start(), i, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [(("assign", "access", "hex")[i], a, b) for a, i, b in sorted(out)]


LAYERS = {
    "": lambda s: s,
    "base64": b64,
    "escape": lambda s: urllib.parse.quote(s),
    "escape>escape": lambda s: "".join(f"%{ord(d):02x}" if d not in "%" else d for d in "".join(f"%{ord(c):02X}" for c in s)),
    "base64>base64": lambda s: b64(b64(s)),
    "base64>escape": lambda s: b64(urllib.parse.quote(s)),
    "base64>gzip": lambda s: b64(gzip.compress(s.encode())),
    "base64>zlib": lambda s: b64(zlib.compress(s.encode())),
    "base64>zstd": lambda s: b64(zstandard.compress(s.encode())),
    "escape>gzip": lambda s: urllib.parse.quote(gzip.compress(s.encode())),
    "escape>zlib": lambda s: repr(zlib.compress(s.encode(), 1))[2:-1],
    "base64>gzip>base64>zlib": lambda s: b64(gzip.compress(b64(zlib.compress(s.encode())).encode())),
    "base64>gzip>gzip": lambda s: b64(gzip.compress(gzip.compress(s.encode()))),
}


@pytest.mark.parametrize("layers", LAYERS)
@pytest.mark.parametrize("before", ["", "Déjà 𝕏 vu: "])
def test_secrets_are_found_in_every_layer(layers, before):
    packed = LAYERS[layers](SECRET)
    text = f"{before}{packed} tail"
    found = [s for s in secrets.spans(text) if s[0] == "assign" and s[3] == layers]
    assert len(found) == 1
    _, start, end, _ = found[0]
    assert len(before) <= start < end <= len(before) + len(packed)
    assert end - start >= 0.8 * len(packed) or layers == "escape>zlib"


def test_unicode_escapes_and_chains():
    for written in ("".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"\\x{ord(c):02x}" for c in SECRET), "".join(f"\\u{{{ord(c):x}}}" for c in SECRET), "".join(f"\\U{ord(c):08X}" for c in SECRET)):
        assert secrets.spans(f"é {written} é") == [("assign", 2, 2 + len(written), "escape")]
    chain = "%" + "25" * 40 + "41KIAABCDEFGHIJKLMNOP"
    assert ("access", 0, len(chain), "escape") in secrets.spans(chain)
    deep = "%%34%31KIAABCDEFGHIJKLMNOPQ"
    assert secrets.spans(deep) == [("access", 0, len(deep), "escape>escape")]
    assert secrets.spans(urllib.parse.quote("é𝕏 ") + urllib.parse.quote(SECRET))[0][1] == len(urllib.parse.quote("é𝕏 "))


def test_base64_over_lines_and_beside_other_signs():
    body = b64("some filler text " * 20 + SECRET + " more" * 20)
    text = "\n".join(body[i : i + 76] for i in range(0, len(body), 76)) + "\nnext"
    kind, start, end, layers = secrets.spans(text)[0]
    assert (kind, layers) == ("assign", "base64") and "\n" in text[start:end]
    for beside in ("path/{}", "a/b/c-{}", "{}/x_y", "=={}=="):
        found = secrets.spans(beside.format(b64(SECRET)))
        assert [s[0] for s in found] == ["assign"], beside
    assert [s[0] for s in secrets.spans("x/" + b64(gzip.compress(SECRET.encode() * 40)))] == ["assign"]


def test_secrets_base_matches_plain_patterns():
    rng = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "ſecret", "toKen", "secret", "=", ":", " ", '"', "'", "abc", "AKIA", "9f", "deadbeef0123", "ABCDEFGHIJKLMN", "+/", ".-_", "é", "%41", "\\u0041", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [s[:3] for s in secrets.spans(text) if not s[3]] == plain_base(text)


def test_what_unpacks_to_too_much_is_said_and_cycles_end(monkeypatch):
    monkeypatch.setattr(secrets, "OPENED", 1000)
    bomb = b64(gzip.compress(b"0" * 5000))
    assert secrets.spans(f"a {bomb} {b64(SECRET)}")[0] == ("oversized", 2, 2 + len(bomb), "")
    assert "assign" in {s[0] for s in secrets.spans(f"a {bomb} {b64(SECRET)}")}
    # Content that unpacks to itself.
    monkeypatch.setattr(secrets, "_inflate", lambda raw: ("gzip", raw, len(raw)) if raw[:2] == b"\x1f\x8b" else None)
    assert secrets.spans(b64(b"\x1f\x8b\x08" + b"\xff" * 40)) == []
    monkeypatch.setattr(secrets, "unescape", lambda layer: secrets.Layer(layer.text, layer.place, (*layer.names, "escape")))
    assert [s[0] for s in secrets.spans("%41 " + SECRET)] == ["assign"]


@pytest.mark.parametrize("text", ["%" + "25" * 200_000, "%5cu0025" * 40_000, "x%9C" * 40_000, "A" * 400_000, "ab/" * 100_000, "H4sI" * 40_000, "%%34%31" * 20_000, "token " * 80_000, "f" * 400_000, "token:" + " " * 300_000])
def test_secrets_of_long_texts_take_linear_time(text):
    began = time.time()
    secrets.spans(text)
    assert time.time() - began < 10


def test_secrets_query(spark, tmp_path):
    from siltstone.llm.queries import QUERIES

    rng = random.Random(8)
    texts = [(i, "".join(rng.choice(["token=", "abcdefABCDEF12", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", " ", "é", '"']) for _ in range(30))) for i in range(200)]
    texts += [(200, None), (201, ""), (None, "secret: abcdefghijkl"), (202, b64(SECRET)), (202, b64(SECRET)), (203, f"{SECRET} {b64(SECRET)}")]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op11_secrets"](spark, str(tmp_path)).collect()
    got, want = Counter(), Counter()
    for r in rows:
        got[r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] += 1
        if r["doc_id"] is not None and r["doc_id"] < 200:
            assert {f"{k}:{a}:{b}" for k, a, b in plain_base(texts[r["doc_id"]][1])} <= set(r["spans"].split(","))
    for i, text in texts:
        base = plain_base(text or "")
        n = Counter(k for k, *_ in base)
        want[i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))] += 1
    assert got == want
    last = [r for r in rows if r["doc_id"] == 203][0]
    assert last["n_hidden"] == 1 and [s.split(":")[0] for s in last["spans"].split(",")] == ["assign", "assign"]


def test_secrets_edges(spark):
    texts = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, SECRET), (4, "word " * 100_000 + SECRET)]
    found = secrets.find(docs(spark, texts))
    assert found.columns == ["doc_id", "text", "n", "form", "kind", "q", "secrets"]
    assert Counter((r["doc_id"], len(r["secrets"])) for r in found.collect()) == Counter({(1, 0): 1, (2, 0): 1, (3, 1): 2, (None, 1): 1, (4, 1): 1})
    clean = {(r["doc_id"], r["text"] if r["doc_id"] != 4 else r["text"][-9:]) for r in secrets.redact(docs(spark, texts)).collect()}
    assert clean == {(1, None), (2, ""), (3, "[secret]"), (None, "[secret]"), (4, " [secret]")}
    none = docs(spark, [])
    assert secrets.find(none).collect() == secrets.redact(none).collect() == []
    assert "text" not in secrets.find(none, drop_text=True).columns
    both = f"x {SECRET} {b64(SECRET)} y"
    assert secrets.redact(docs(spark, [(1, both)])).first()["text"] == "x [secret] [secret] y"


# op12


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def test_ropes_cut_and_join_like_lists():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "𝕏", " ", "\n", "  ", "bc\t"]) for _ in range(rng.choice([0, 1, 5, 50, 3000])))
        own = units(text)
        rope = infill.build(text)
        assert infill.flat(rope) == text and (rope.units if rope else 0) == len(own) and (rope.chars if rope else 0) == len(text)
        for rank in {0, 1, len(own) // 3, len(own), len(own) + 1}:
            a, b = infill.cut(rope, rank)
            assert infill.flat(a) == "".join(own[:rank]) and infill.flat(b) == "".join(own[rank:])
            assert (a.units if a else 0) == min(rank, len(own))
            back = infill.concat(b, a)
            assert infill.flat(back) == "".join(own[rank:] + own[:rank])
        at = rng.randint(0, len(text))
        a, b = infill.cut(rope, at, "chars")
        assert (infill.flat(a), infill.flat(b)) == (text[:at], text[at:])


def test_ropes_stay_balanced():
    rope, rng = infill.build("w " * 60_000), random.Random(1)
    for _ in range(200):
        a, b = infill.cut(rope, rng.randint(0, rope.units))
        rope = infill.concat(b, a)
    nodes = sum(1 for _ in rope.leaves())
    assert rope.units == 60_001 or rope.units >= 60_000
    assert rope.height <= 2 * np.log2(nodes) + 2


def plain_fim(text, key, rate=50, suffix_first=80, seed=42):
    own, digest = units(text), sha(f"{seed}:{key}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, "plain", len(own), None, None
    a, b = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    return (f"<S>{s}<P>{p}<M>{m}", "spm") + (len(own), len(p), len(m)) if h4 % 100 < suffix_first else (f"<P>{p}<S>{s}<M>{m}", "psm") + (len(own), len(p), len(m))


def test_fim_matches_plain_lists_and_comes_back():
    rng = random.Random(4)
    seen = Counter()
    for i in range(3000):
        text = "".join(rng.choice("ab<>PSM é𝕏\t\n  ") for _ in range(rng.randint(0, 60)))
        rate = rng.choice([50, 100])
        got = infill.transform(text, str(i), rate=rate)
        assert got == plain_fim(text, str(i), rate)
        assert infill.restore(got[0], got[1]) == text
        seen[got[1]] += 1
    assert min(seen[f] for f in ("plain", "psm", "spm")) > 100
    for text in ("<P", "<", "a <", "<S", "x" * 300_000, "w " * 200_000, " " * 200_000):
        out, form, *_ = infill.transform(text, "3", rate=100)
        assert form != "plain" and infill.restore(out, form) == text


def test_fim_edges(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "one two three"), (4, "<M> inside"), (5, " "), (6, "word " * 50_000)]
    frame = docs(spark, texts)
    made = infill.rearrange(frame, rate=100)
    assert made.columns == ["doc_id", "text", "secrets", "kind", "q", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = {r["doc_id"]: r for r in made.collect()}
    assert made.count() == len(texts)
    for i, text in texts:
        want = plain_fim(text or "", "" if i is None else i, 100)
        assert (rows[i]["output"], rows[i]["form"], rows[i]["n"], rows[i]["prefix_chars"], rows[i]["middle_chars"]) == want
    hashed = infill.rearrange(frame, drop_text=True, digests=True)
    assert "text" not in hashed.columns
    assert {r["doc_id"]: r["restored_sha256"] for r in hashed.collect()} == {i: sha(t or "") for i, t in texts}
    assert infill.rearrange(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        infill.rearrange(frame.withColumnRenamed("text", "t2").withColumnRenamed("form", "text").withColumnRenamed("n", "output"), text="output")


# op13


def brute(rows, positives=5, count=5):
    kept = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(256 * x)) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and None not in v and np.isfinite(np.array(v, float)).all()})
    out = []
    for anchor in kept:
        if anchor[0] % 100:
            continue
        score = lambda r: sum(a * b for a, b in zip(anchor[2], r[2]))  # noqa: E731, B023
        first = lambda some, k: sorted(some, key=lambda r: (-score(r), r[0]))[:k]  # noqa: E731, B023
        for p in first([r for r in kept if r[1] == anchor[1] and r[0] != anchor[0]], positives):
            fit = [r for r in kept if r[1] != anchor[1] and 80 * score(p) <= 100 * score(r) <= 100 * score(p)]
            out += [(anchor[0], p[0], k, r[0], score(p), score(r)) for k, r in enumerate(first(fit, count), 1)]
    return Counter(out)


def mined(df, **options):
    return Counter(tuple(r) for r in negatives.mine(df, **options).collect())


VECTORS = "vec_id long, embedding array<float>, label int, id string, query string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)


@pytest.mark.parametrize("hot", [False, True])
def test_negatives_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 6 * 7)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        v = rng.normal(size=6) * rng.choice([0.2, 1, 3])
        if hot and i % 3:
            v = np.array([1.0, 0.5, 0, 0, 0, -0.25])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if not hot else int(i % 2)))
    rows += [(1500, None, 1), (1600, [1.0] * 6, None), (1700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1800, [float("nan")] * 6, 1), (1900, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), rows[5], rows[100], (2000, [0.0] * 6, 1)]
    assert mined(vectors(spark, rows).repartition(3)) == brute(rows)
    assert mined(vectors(spark, rows), positives=2, negatives=9) == brute(rows, 2, 9)


def test_negatives_small_and_large_values(spark):
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1e4, 1e6):
        rows = [(i * 50, [float(np.float32(x)) for x in rng.normal(size=4) * scale], i % 3) for i in range(60)]
        assert mined(vectors(spark, rows)) == brute(rows)
    assert mined(vectors(spark, [])) == Counter()
    assert mined(vectors(spark, [(1, [1.0], 2)])) == mined(vectors(spark, [(100, [1.0], 2)])) == Counter()
    # Shorter vectors count as filled with zeros; one beyond the longs takes no part.
    rows = [(100, [1.0, 2.0], 1), (101, [1.0], 1), (102, [0.9, 0.0], 2), (103, [0.0, 0.45], 2), (104, [], 3)]
    assert mined(vectors(spark, [*rows, (105, [1e30, 0.0], 2)])) == brute(rows)


def test_leaf_ranges_hold_all_distances():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(700, 5)), np.zeros((200, 5))])
    tree = negatives.Tree(points, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(900)) and max(map(len, tree.leaves)) <= 16
    queries = rng.normal(size=(30, 5)) * 2
    least, most = tree.ranges(queries, (queries**2).sum(1))
    away = np.linalg.norm(queries[:, None] - points, axis=2)
    for i, leaf in enumerate(tree.leaves):
        assert (away[:, leaf].min(1) >= least[:, i] - 1e-6).all() and (away[:, leaf].max(1) <= most[:, i] + 1e-6).all()
    assert (tree.route(points) < len(tree.leaves)).all()


def test_windows_are_exact():
    score = np.array([0, 1, 2, 4, 5, 99, 100, 101, 12345, -1, -7, 2**61 + 3])
    low, high = negatives.window(score)
    assert (high == score).all()
    for s, least in zip(score.tolist(), low.tolist()):
        assert 80 * s <= 100 * least and 80 * s > 100 * (least - 1)


# Short near-duplicates, and names that clash


def test_short_texts_with_one_word_changed_are_one_class(spark):
    from siltstone.llm import near_dup

    rows = []
    for n in (4, 5, 6, 7, 9, 12, 30):
        own = [f"k{n}w{i}" for i in range(n)]
        rows += [(n * 10, " ".join(own)), (n * 10 + 1, " ".join(own[: n // 2] + ["other"] + own[n // 2 + 1 :])), (n * 10 + 2, " ".join([*own, "more"]))]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in (5, 6, 7, 9, 12, 30):
        assert found[n * 10] == found[n * 10 + 1] == found[n * 10 + 2] == n * 10
    # One of four words is a quarter.
    assert found[40] == found[42] == 40 and found[41] == 41


def test_substring_columns_may_have_any_name(spark):
    from siltstone.llm import substring

    text = " ".join(f"w{i}" for i in range(40))
    names = ("_k1", "_k2", "_copies", "_starts", "_maybe", "_m_at", "_m_slot", "_m_bits", "_k1_")
    rows = [(1, text, *names), (2, text + " end", *names), (3, None, *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = substring.remove_repeats(frame)
    assert out.columns == ["doc_id", "text", *names, "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert {(r["doc_id"], r["n_removed"], *(r[n] for n in names)) for r in out.collect()} == {(1, 40, *names), (2, 40, *names), (3, 0, *names)}
    assert substring.remove_repeats(frame.limit(0)).collect() == []
