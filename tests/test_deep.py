"""Flows over assignments, the index of rules, diffs, versions and the history by day."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone import versions
from siltstone.functions import literals, text
from siltstone.operators import baseline, changes, detect, flows, report
from siltstone.schemas import BASELINE
from siltstone.sources import files


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def plain_flows(body):
    """{(rule, source line, sink line): hops} by walking back from each line over the last assignments before it."""
    rows = body.split("\n")
    cleans = [bool(re.search(text.SANITIZERS, x)) for x in rows]
    fills = [re.search(text.SOURCES["python"], x) for x in rows]
    sets = [re.search(flows.ASSIGN["python"], x) for x in rows]
    target = [f[1] if f else s[1] if s else "" for f, s in zip(fills, sets)]
    words = [re.findall(r"\w+", re.sub(flows.HEAD["python"], "", x)) for x in rows]
    every = [set(w) | {t} for w, t in zip(words, target)]
    last = lambda v, j: max((i for i in range(j) if target[i] == v), default=None)

    def before(j):
        for v in set(words[j]):
            i = last(v, j)
            if i is not None and not any(cleans[k] and v in every[k] for k in range(i + 1, j + 1)):
                yield i

    reach = [{} for _ in rows]
    for j in range(len(rows)):
        if fills[j] and not cleans[j]:
            reach[j][j] = 0
        if target[j] and not cleans[j]:
            for i in before(j):
                for s, n in reach[i].items():
                    reach[j][s] = min(reach[j].get(s, 99), n + 1)
    out = {}
    for j, x in enumerate(rows):
        for name, (pattern, _) in text.SINKS.items():
            if re.search(pattern, x):
                for i in before(j):
                    for s, n in reach[i].items():
                        key = (f"taint.{name}", s + 1, j + 1)
                        out[key] = min(out.get(key, 99), n)
    return out


def test_flows_over_any_hops_equal_a_walk_back(spark):
    rng = random.Random(7)
    shapes = ("{a} = request.form['k']", "{a} = {b}", "{a} = f({b}, {a})", "{a} += {b}", "db.execute({a})", "os.system({a} + {b})", "{a} = int({b})", "{a} = 1", "sanitize({a})", "{a} == {b}", "", "{a} = db.query({b})")
    texts = {f"f{k}": "\n".join(rng.choice(shapes).format(a=rng.choice("xyzuv"), b=rng.choice("xyzuv")) for _ in range(rng.randint(0, 25))) for k in range(200)}
    want = {(path, *key, n) for path, body in texts.items() for key, n in plain_flows(body).items()}
    rows = flows.dataflows(sources(spark, texts)).collect()
    got = {(r["path"], r["rule_id"], r["source_line"], r["sink_line"], r["hops"]) for r in rows}
    assert len(rows) == len(got) and got == want and {n for *_, n in want} >= {0, 1, 2, 3}
    for r in rows:
        steps = r["dataflow"]
        assert [s["label"] for s in steps] == ["source", *["step"] * r["hops"], "sink"]
        assert steps[0]["line"] == r["source_line"] and steps[-1]["line"] == r["sink_line"]
        assert all(a["line"] < b["line"] for a, b in zip(steps, steps[1:]))
    few = {(r["path"], r["rule_id"], r["source_line"], r["sink_line"], r["hops"]) for r in flows.dataflows(sources(spark, texts), hops=1).collect()}
    assert few == {w for w in want if w[-1] <= 1}


def test_flows_of_long_chains_cycles_and_scripts(spark):
    chain = "\n".join(["a0 = input()", *(f"a{i + 1} = w(a{i})" for i in range(6)), "os.system(a6)"])
    ring = "a = input()\nb = a\na = b\nb = a\nexec(b)"
    script = "const q = req.query.id\nlet w = wrap(q)\n  t = `x${w}`\nconst f = (t) => t\nif (t == q) {}\ndb.query(t)"
    got = {(r["path"], r["hops"], r["variable"]) for r in flows.dataflows(sources(spark, {"chain": chain, "ring": ring, "none": "", "safe": "x = 'a'\nexec(x)"})).collect()}
    assert got == {("chain", 6, "a6"), ("ring", 3, "b")}
    assert [(r["hops"], r["variable"]) for r in flows.dataflows(sources(spark, {"s": script}), "typescript").collect()] == [(2, "t")]
    assert flows.dataflows(sources(spark, {"x": "y"}).limit(0)).collect() == []


@pytest.mark.parametrize(
    "pattern, literal",
    [("abc", "abc"), (r"db\.query\(", "db.query("), ("abc|de", ""), ("ab?cdef", "cdef"), ("abc+de", "abc"), ("(abc|d)efgh", "efgh"), ("[abc]defg[^x]", "defg"), (r"\bword\b", "word"), (r"a\d{3}bcd", "bcd"), ("(?i)abcd", ""), ("abc{0,2}def", "def"), ("x*", ""), ("", ""), (r"[]x]abc", "abc"), (r"a(b(c)\)d)efg", "efg"), (r"\x41bcd efg", " efg"), (r"(?:ab)+cde", "cde")],
)
def test_required_literals(pattern, literal):
    assert literals.required(pattern) == literal


def test_required_literals_are_in_every_match():
    rng = random.Random(3)
    parts = ["a", "b", "c", "ab", "[ab]", "(a|b)", "(bc)", "c?", "b*", "a+", r"\.", ".", "a{2}", "b{0,1}", "^", "$", r"\w"]
    hits = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        literal = literals.required(pattern)
        for _ in range(10):
            m = re.search(pattern, "".join(rng.choice("abc.") for _ in range(12)))
            if m:
                hits += bool(literal)
                assert literal in m.group()
    assert hits > 1000


def test_many_rules_hit_as_the_plain_loop_does(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 5)))
    rules = [(f"r{k}", rng.choice(["{}", r"{}\(", "{}|x{}", "[a-c]{}", "{}.*{}", "(?i){}", r"\b{}\b"]).format(word(), word()), "low", None) for k in range(5000)]
    lines = [(f"p{k % 7}", k, " ".join(word() + rng.choice(["", "(", "."]) for _ in range(rng.randint(0, 4)))) for k in range(60)]
    rows = spark.createDataFrame([*lines, ("p", 1, None)], "path string, line int, text string")
    want = {(p, n, r) for p, n, t in lines for r, pattern, *_ in rules if re.search(pattern, t)}
    got = [(r["path"], r["line"], r["rule_id"]) for r in detect.apply_many_rules(rows, spark.createDataFrame(rules, "rule_id string, pattern string, severity string, cwe string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    none = spark.createDataFrame([], "rule_id string, pattern string, severity string, cwe string")
    assert detect.apply_many_rules(rows, none).collect() == []


DIFF = """commit 1

    message

diff --git a/src/one.py b/src/one.py
index 1..2 100644
--- a/src/one.py
+++ b/src/one.py
@@ -1,4 +1,6 @@ def f():
 same
-old
+new
+newer
 same
+last
\\ No newline at end of file
@@ -40 +42,2 @@
+++ counts as a line
 x
diff --git a/was.txt b/now.txt
similarity index 100%
rename from was.txt
rename to now.txt
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/my file.md b/my file.md
new file mode 100644
--- /dev/null
+++ b/my file.md
@@ -0,0 +1,2 @@
+a
+b
diff --git a/pic.png b/pic.png
Binary files differ
"""


def test_diffs_are_files_and_ranges(spark):
    rows = spark.createDataFrame([("d", DIFF), ("plain", "--- a.c\t2024\n+++ a.c\t2025\n@@ -3 +3 @@\n-x\n+y\n"), ("crlf", "diff --git a/w.c b/w.c\r\n--- a/w.c\r\n+++ b/w.c\r\n@@ -1 +1,2 @@\r\n x\r\n+y\r\n"), ("none", None), ("empty", "")], "id string, diff string")
    got = {(r["id"], r["file"], r["previous"], r["kind"], tuple(map(tuple, r["ranges"]))) for r in changes.changes(rows).collect()}
    assert got == {
        ("d", "src/one.py", None, "modified", ((2, 3), (5, 5), (42, 42))),
        ("d", "now.txt", "was.txt", "renamed", ()),
        ("d", "gone.py", None, "deleted", ()),
        ("d", "my file.md", None, "added", ((1, 2),)),
        ("d", "pic.png", None, "modified", ()),
        ("plain", "a.c", None, "modified", ((3, 3),)),
        ("crlf", "w.c", None, "modified", ((2, 2),)),
    }
    assert {r["file"] for r in changes.changed_files(changes.changes(rows)).collect()} == {"src/one.py", "now.txt", "my file.md", "pic.png", "a.c", "w.c"}


def test_overlaps_equal_all_pairs_without_comparing_them(spark):
    rng = random.Random(2)
    spans = lambda n: [(i, rng.choice("ab"), a, a + rng.choice([0, 0, 3, 400, 2000])) for i in range(n) for a in [rng.randint(1, 3000)]]
    one, two = spans(80), sorted({s[1:] for s in spans(60)})
    left = spark.createDataFrame(one, "id int, file string, first int, last int")
    right = spark.createDataFrame(two, "file string, first int, last int")
    both = changes.overlapping(left, right)
    got = [(r["id"], r["file"], r["r_first"], r["r_last"]) for r in both.collect()]
    assert sorted(got) == sorted((i, f, c, d) for i, f, a, b in one for g, c, d in two if f == g and a <= d and c <= b)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "base")
    found = lambda *keys: spark.createDataFrame([(k, "") for k in keys], "fingerprint string, fingerprint_v1 string")
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-0{d}"))
    assert baseline.create(spark, folder, found("a"), day(1)) == 1
    calls = []

    def slow(known):
        calls.append(known.count())
        if len(calls) == 1:
            assert baseline.update(spark, folder, found("b"), day(2)) == 2
        return baseline.updated(known, found("c", "a"), day(3))

    assert versions.commit(spark, folder, BASELINE, slow) == 3 and calls == [1, 2]
    assert {(r["fingerprint"], r["first_seen"].day) for r in baseline.latest(spark, folder).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    # A pointer is never written over.
    assert not versions._claimed(spark, folder, 3, "data-other") and versions.newest(spark, folder)[0] == 3
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, BASELINE, lambda known: baseline.update(spark, folder, found("d"), day(4)) and known, tries=2)
    assert versions.vacuum(spark, folder, keep=1) == 4 and baseline.latest(spark, folder).count() == 4


def test_a_crash_before_the_pointer_leaves_the_version(spark, tmp_path, monkeypatch):
    folder, kind = str(tmp_path / "plan"), "target string"
    plan = lambda *t: (lambda old: spark.createDataFrame([(x,) for x in t], kind))
    report.save_plan(spark, folder, kind, plan("a", "b"), "s1")

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(versions, "_claimed", crash)
    with pytest.raises(OSError):
        report.save_plan(spark, folder, kind, plan("c"), "s2")
    monkeypatch.undo()
    assert {tuple(r) for r in report.load_plan(spark, folder, kind).collect()} == {("a", "s1"), ("b", "s1")}
    assert report.save_plan(spark, folder, kind, plan("c"), "s2") == "s1"


def test_history_is_by_day_and_repeats_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "history")
    kind = "scan_id string, timestamp string, total_findings int, severity_counts map<string,int>, fingerprints array<string>"
    rows = spark.createDataFrame([(f"s {d}", f"2024-01-0{d}T10:00:00Z", d, {"high": d}, ["a"]) for d in range(1, 6)] + [("odd", "no time", 1, {}, [])], kind)
    report.append_history(rows, folder)
    report.append_history(rows.filter("total_findings > 2"), folder)
    again = spark.createDataFrame([("s 5", "2024-01-05T10:00:00Z", 50, {}, []), ("t 5", "2024-01-05T11:00:00Z", 1, {}, [])], kind)
    report.append_history(again, folder)
    got = [(r["scan_id"], r["total_findings"]) for r in files.load_history(spark, folder).collect()]
    assert got == [("t 5", 1), ("s 5", 50), ("s 4", 4), ("s 3", 3), ("s 2", 2), ("s 1", 1), ("odd", 1)]
    late = files.load_history(spark, folder, since="2024-01-04")
    assert [r["scan_id"] for r in late.collect()] == ["t 5", "s 5", "s 4"]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*scan_date", plan)


RULES = """# head
---
rules:
  - message: |
      - id: not this
        id: nor this
    id: second-key
    languages: [python, go]
    paths:
      include:
      - id: inner
      - "*.py"   # kept
    metadata:
      cwe:
        - CWE-1
        - 'CWE-2 # no comment'
      empty:

  - id: "quoted"  # named
    severity: HIGH
other:
  - id: elsewhere
"""


def test_nested_configuration_is_read_by_key_path(spark):
    got = [tuple(r) for r in files.config_entries(sources(spark, {"a.yml": RULES})).select("key", "value").collect()]
    assert got == [
        ("rules[0].id", "second-key"),
        ("rules[0].languages", "[python, go]"),
        ("rules[0].paths.include[0].id", "inner"),
        ("rules[0].paths.include[1]", "*.py"),
        ("rules[0].metadata.cwe[0]", "CWE-1"),
        ("rules[0].metadata.cwe[1]", "CWE-2 # no comment"),
        ("rules[1].id", "quoted"),
        ("rules[1].severity", "HIGH"),
        ("other[0].id", "elsewhere"),
    ]
    both = sources(spark, {"a.yml": RULES, "b.yml": "rules:\n- id: flat\n  severity: LOW\n- severity: HIGH\n  id: late\n", "none.yml": "", "odd.yml": "just text\n- x"})
    assert {tuple(r) for r in files.rule_ids(both).collect()} == {("a.yml", "second-key"), ("a.yml", "quoted"), ("b.yml", "flat"), ("b.yml", "late")}
    fields = {(r["path"], r["rule"], r["rule_id"], r["field"]): r["value"] for r in files.rule_fields(both).collect()}
    assert fields["b.yml", 1, "late", "severity"] == "HIGH" and fields["a.yml", 0, "second-key", "paths.include[0].id"] == "inner"
    assert files.config_entries(spark.createDataFrame([("x", None)], "path string, text string")).collect() == []


def test_layers_of_configuration(spark):
    layers = [("u", 0, "gate:\n  fail_on: low\n  deep:\n    a: 1\nskip:\n- a\n- b\n"), ("u", 1, "gate:\n  deep: none\nskip:\n  - c\n"), ("v", 0, "gate:\n  fail_on: high\n")]
    got = {tuple(r) for r in files.layered_config(spark.createDataFrame(layers, "who string, layer int, text string"), "who").collect()}
    assert got == {("u", "gate.fail_on", "low"), ("u", "gate.deep", "none"), ("u", "skip[0]", "c"), ("v", "gate.fail_on", "high")}


def test_sql_text_gives_what_the_operators_give(spark):
    from siltstone import surface
    from siltstone.functions import paths, severity
    from siltstone.operators import triage
    from siltstone.sources import tables

    # Else the plan may read what another test has cached.
    spark.catalog.clearCache()
    rows = tables.findings(spark, "/root/testdata/sf0.001")
    names = surface.register(rows)
    assert {"gate", "open_findings", "per_file", "severity_rank"} <= set(names)
    for level, review in (("high", False), ("medium", True), ("info", False)):
        by_text = spark.sql(f"SELECT * FROM gate('{level}', {str(review).lower()})").first().asDict()
        assert by_text == triage.gate(rows, level, review).first().asDict()
    assert spark.sql("SELECT * FROM open_findings()").columns == rows.columns
    odd = spark.createDataFrame([(s, p) for s in ("HIGH", "info", "odd", None) for p in ("tests/a.py", "a/b.pb.go", "x.py")], "s string, p string")
    odd.createOrReplaceTempView("odd")
    same = spark.sql("SELECT severity_rank(s) a, severity_reduced(s) b, is_test_path(p) c, is_generated_path(p) d, s, p FROM odd")
    own = odd.select(severity.rank(F.col("s")).alias("a"), severity.reduced(F.col("s")).alias("b"), paths.is_test(F.col("p")).alias("c"), paths.is_generated(F.col("p")).alias("d"), "s", "p")
    assert sorted(map(str, same.collect())) == sorted(map(str, own.collect()))
    # A filter over a function reaches the scan, and only its columns are read.
    plan = spark.sql("SELECT id FROM open_findings('low') WHERE event_id > 900")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(event_id,900\)", plan) and "props" not in re.search(r"ReadSchema: .*", plan)[0]


def test_flows_of_short_files_take_no_shuffle_and_equal_rounds(spark, monkeypatch):
    rng = random.Random(5)
    shapes = ("{a} = request.form['k']", "{a} = {b}", "{a} = f({b}, {a})", "{a} += {b}", "db.execute({a}, {b})", "os.system({a} + {b})", "{a} = int({b})", "{a} = request.args[{b}]", "sanitize({a})", "exec(eval({a}))", "{a} = db.query({b})")
    texts = {f"f{k}": "\n".join(rng.choice(shapes).format(a=rng.choice("xyzuv"), b=rng.choice("xyzuv")) for _ in range(rng.randint(0, 40))) for k in range(150)}
    files, tags, settled = sources(spark, texts), [], flows.settle
    monkeypatch.setattr(flows, "settle", lambda df, tag, **more: tags.append(tag) or settled(df, tag, **more))
    for hops in (None, 0, 2):
        tags.clear()
        short = flows.dataflows(files, hops=hops)
        assert tags == ["taint-long"] and "Exchange" not in short._jdf.queryExecution().executedPlan().toString()
        for bound in (1, 20):
            monkeypatch.setattr(flows, "SHORT", bound)
            rounds = flows.dataflows(files, hops=hops).collect()
            monkeypatch.undo()
            monkeypatch.setattr(flows, "settle", lambda df, tag, **more: tags.append(tag) or settled(df, tag, **more))
            assert sorted(map(repr, short.collect())) == sorted(map(repr, rounds)) and len(rounds) > 50
