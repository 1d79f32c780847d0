"""What only showed on larger tables: ids with more digits, sets too large for a row, work done again for each use."""

from siltstone.operators import score


def test_cases_from_100_000_on_have_six_digits(spark):
    raw = spark.createDataFrame([("src/BenchmarkTest99999.java", ["CWE-89"]), ("src/BenchmarkTest100000.java", ["CWE-79"]), ("src/BenchmarkTest0001.java", ["CWE-79"])], "path string, cwe array<string>")
    assert {(r["name"], *r["found"]) for r in score.detections(raw).collect()} == {("BenchmarkTest99999", 89), ("BenchmarkTest100000", 79)}


def test_bodies_and_edges_shuffle_no_bodies(spark, tmp_path):
    from siltstone.operators import calls
    from siltstone.plans import catalogue

    rows = spark.createDataFrame([("a.ts", "import { run } from './b'\nfunction a() {\n  run(); own()\n}\nfunction own() {\n}"), ("b.ts", "export function run() {\n}")], "path string, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(calls.bodies(rows))
    # The tree is read into functions once, before the edges: their plan takes no body apart.
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(20).write.parquet(str(tmp_path / "events.parquet"))
    assert "prisma" not in plan(catalogue.QUERIES["call_edges"](spark, str(tmp_path)))
    assert {tuple(r) for r in calls.edges(calls.bodies(rows), calls.imports(rows)).collect()} == {("a.ts", "a", "b.ts", "run"), ("a.ts", "a", "a.ts", "own")}


def test_rules_of_one_pattern_hit_together_and_lines_stay_where_they_are(spark):
    from siltstone.operators import detect

    rows = spark.createDataFrame([("a", 1, "say \U0001f600 conversation now"), ("a", 2, None), ("b", 1, "no")], "path string, line int, text string")
    rules = spark.createDataFrame([("r1", "conversation", "low", None), ("r2", "conversation", "high", "CWE-1"), ("r3", "con[v]", "low", None), ("r4", "[n]o", "low", None)], "rule_id string, pattern string, severity string, cwe string")
    found = detect.apply_many_rules(rows, rules)
    assert {(r["path"], r["line"], r["rule_id"]) for r in found.collect()} == {("a", 1, "r1"), ("a", 1, "r2"), ("a", 1, "r3"), ("b", 1, "r4"), ("a", 1, "r4")}


def test_rule_fields_need_no_join(spark):
    from siltstone.sources import files

    text = "rules:\n  - severity: low\n    id: b\n  - note: none\n  - id: c\n    id: a\n"
    found = files.rule_fields(spark.createDataFrame([("r.yml", text), ("none.yml", None)], "path string, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["rule"], r["rule_id"], r["field"], r["value"]) for r in found.collect()} == {(0, "b", "severity", "low"), (0, "b", "id", "b"), (1, None, "note", "none"), (2, "a", "id", "c"), (2, "a", "id", "a")}


def test_rules_for_whole_words_meet_words_and_none_comes_to_the_driver(spark, monkeypatch):
    import random
    import re

    from siltstone.operators import detect

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abAZ019_é") for _ in range(rng.randint(1, 3)))
    rules = []
    for k in range(900):
        signs = detect.SIGNS[k % 3]
        own = "".join(re.findall(f"[{signs}]", word())) or "a"
        rules.append((f"r{k}", f"(^|[^{signs}]){own}([^{signs}]|$)", "low", None if k % 2 else "CWE-1"))
    lines = [(f"p{k % 3}", k % 50, " ".join(word() + rng.choice(["", "\t", ".", "-b"]) for _ in range(rng.randint(0, 5)))) for k in range(120)]
    rows = spark.createDataFrame([*lines, lines[0], ("p", 1, None)], "path string, line int, text string")
    known = spark.createDataFrame([*rules, ("none", None, "low", None)], "rule_id string, pattern string, severity string, cwe string")
    want = sorted((p, n, r) for p, n, t in [*lines, lines[0]] for r, pattern, *_ in rules if re.search(pattern, t))
    hits = detect.apply_many_rules(rows, known.filter("pattern is not null"))
    # Read off by the driver are only patterns of other forms.
    with monkeypatch.context() as m:
        m.setattr(detect.literals, "required", lambda _: 1 / 0)
        assert "NestedLoop" not in detect.apply_many_rules(rows, known.filter("pattern is not null"))._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["path"], r["line"], r["rule_id"]) for r in hits.collect()) == want and len(want) > 1000
    # Beside others, and near forms: another class on each side, more than a word, text after the form.
    near = ["(^|[^A-Za-z])a([^A-Za-z0-9]|$)", "(^|[^A-Za-z])a+([^A-Za-z]|$)", "(^|[^A-Za-z])b1([^A-Za-z]|$)", "(^|[^A-Za-z])a([^A-Za-z]|$)A", "a(?:b|A)", "(?:^|[^A-Za-z])Z(?:[^A-Za-z]|$)"]
    more = [(f"n{k}", pattern, "low", None) for k, pattern in enumerate(near)]
    want = sorted((p, n, r) for p, n, t in [*lines, lines[0]] for r, pattern, *_ in [*rules[:30], *more] if re.search(pattern, t))
    some = spark.createDataFrame([*rules[:30], *more, ("none", None, "low", None)], known.schema)
    assert sorted((r["path"], r["line"], r["rule_id"]) for r in detect.apply_many_rules(rows, some).collect()) == want


def test_calls_of_open_functions_meet_files_by_module_alone(spark):
    import random

    from siltstone.operators import calls

    rng = random.Random(4)
    heads = ["import { a, b as c } from './m1'", "import b from './m2'", "import * as w from './m1'", "import { b } from './m3'", "const { u, a } = require('./m2')", "const w = require('../d/m0')", "import { default as a } from './m4'"]
    said = ["a()", "b()", "c(1)", "w.a()", "w.c()", "b.u()", "u()", "$a()", "w.$b()", "other()", "x.a()", "userId", "db.item.find()"]

    def text():
        out = [rng.choice(heads) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 4)):
            out += [rng.choice(["", "export ", "export default "]) + f"function {rng.choice(['a', 'b', 'c', 'u', 'default', 'GET'])}() {{", *(rng.choice(said) for _ in range(rng.randint(0, 4))), "}"]
        return "\n".join(out)

    rows = spark.createDataFrame([(f"{r}/d/m{k}{e}", text()) for r in range(60) for k in range(5) for e in (".ts", ".js", "/index.ts") if rng.random() < 0.6], "path string, text string").cache()
    free = calls.bodies(rows).filter("not has_check").select("path", "name")
    links = calls.edges(calls.bodies(rows), calls.imports(rows)).join(free, ["path", "name"], "left_semi").join(free.toDF("to_path", "to_name"), ["to_path", "to_name"], "left_semi")
    want = {(r["path"], r["name"], r["to_path"], r["to_name"]) for r in links.collect()}
    known = calls._resolved(rows, None).cache()
    known.count()
    got = calls._open_links(known)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    # Calls and files are shuffled by module, and what a file imports is not joined with what it calls.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("Join [module" in x for x in joins)


def test_a_text_is_outlined_whole(spark):
    from siltstone.operators import calls

    text = "import x\n  touch(key)\nexport default function a(b, { c }) { // {\n  say('}', \"{\", `(`)\n\n  if (x) {\n  };\n}\x01\nconst f = (x): P<{ y }> =>\n  x\n"
    outline = spark.createDataFrame([(text,)], "text string").select(calls._outline(calls.F.col("text"))).first()[0].split("\n")
    assert outline == ["", "", "\x01a\x01export default \x01({}){", "", "", "{", "}\x02", "}", "\x01f\x01\x01{}", "", ""]
