"""Function bodies, imports and the calls between files."""

from siltstone.operators import calls
from siltstone.plans import catalogue


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def bodies(spark, text):
    return {r["name"]: (r["first"], r["last"]) for r in calls.bodies(sources(spark, {"a.ts": text})).collect()}


def test_bodies_end_where_their_brackets_close(spark):
    assert bodies(spark, "function a() { return 1 }\nfunction b(\n  x,\n  { y }\n)\n{\n  if (x) {\n  }\n}\nconst c = (x) => {\n  go()\n}\n") == {"a": (1, 1), "b": (2, 9), "c": (10, 12)}
    # Inner functions, brackets in quotes and comments, a declaration, and a body that the file leaves open.
    text = "function outer() {\n  function inner() {\n    log('}') // }\n  }\n  inner()\n}\nfunction said(x: string): void;\nasync function rest() {\n  go()"
    assert bodies(spark, text) == {"outer": (1, 6), "inner": (2, 4), "said": (7, 7), "rest": (8, 9)}
    assert bodies(spark, "const f = async x => {\r\n  g()\r\n}\r\nlet n = 4") == {"f": (1, 3)}
    assert bodies(spark, "") == {} and bodies(spark, None) == {} and bodies(spark, "x\n" * 1000) == {}


def test_of_equal_names_in_a_file_the_first_counts(spark):
    assert bodies(spark, "function a() {\n}\nfunction a() {\n  b()\n}") == {"a": (1, 2)}


def test_imports_in_all_their_forms(spark):
    text = "import main, { a, b as c, type D } from './near'\nimport * as all from '../up/index'\nimport { e } from '@/top/e'\nimport { f } from 'package'\nimport { g } from '../../../out'\nconst { h: i, j } = require('./old')\nconst k = require(\"./whole\")"
    got = {(r["local"], r["module"], r["name"]) for r in calls.imports(sources(spark, {"x/y/m.ts": text, "empty.ts": "", "none.ts": None})).collect()}
    want = {("f", None, "f"), ("g", None, "g"), ("main", "x/y/near", "default"), ("a", "x/y/near", "a"), ("c", "x/y/near", "b"), ("D", "x/y/near", "D"), ("all", "x/up", "*"), ("e", "top/e", "e"), ("i", "x/y/old", "h"), ("j", "x/y/old", "j"), ("k", "x/y/whole", "*")}
    assert got == want


def linked(spark, texts, **more):
    rows = sources(spark, texts)
    return {tuple(r) for r in calls.edges(calls.bodies(rows), calls.imports(rows, **more)).collect()}


def test_calls_go_where_imports_lead(spark):
    texts = {
        "app/a.ts": "import { run } from './one'\nimport main from './two'\nimport * as two from './two'\nfunction start() {\n  run(); main(); two.go(); other.go(); go(); missing()\n}",
        "app/one.ts": "export function run() {\n  go()\n}\nfunction go() {\n}",
        "app/two/index.ts": "export default function whatever() {\n}\nexport function go() {\n}",
        "app/two.js": "export function go() {\n}",
        "far/one.ts": "export function run() {\n}",
    }
    assert linked(spark, texts) == {
        ("app/a.ts", "start", "app/one.ts", "run"),
        ("app/a.ts", "start", "app/two/index.ts", "whatever"),
        ("app/a.ts", "start", "app/two/index.ts", "go"),
        ("app/one.ts", "run", "app/one.ts", "go"),
    }


def test_aliases_and_imported_names_hide_own_ones(spark):
    texts = {"a.ts": "import { run } from '~/lib'\nfunction f() {\n  run()\n}\nfunction run() {\n}", "src/lib.ts": "export function run() {\n}"}
    assert ("a.ts", "f", "src/lib.ts", "run") in linked(spark, texts, aliases={"~/": "src/"})
    # Imported from nowhere known: no edge, to the own function neither.
    assert not [e for e in linked(spark, texts) if e[:2] == ("a.ts", "f") and e[3] == "run"]


def test_handlers_reach_queries_over_calls_and_cycles(spark):
    inner = "export function read(k) {\n  return db.item.findFirst({ k })\n}\n"
    route = "import { load } from '@/service'\nexport async function GET(req) {\n  return load(req)\n}\nexport async function POST(req) {\n  if (row.ownerId !== me) return no()\n  return load(req)\n}\n"
    texts = {"app/x/route.ts": route, "service.ts": "import { read } from './inner'\nexport function load(k) {\n  return again(k)\n}\nfunction again(k) {\n  load(k)\n  return read(k)\n}", "inner.ts": inner, "other.ts": inner}
    found = calls.missing_authorization(sources(spark, texts)).collect()
    assert [(r["path"], r["method"], r["to_path"], r["to_name"], r["calls"]) for r in found] == [("app/x/route.ts", "GET", "inner.ts", "read", 3)]
    assert [tuple(t) for t in found[0]["trail"]] == [("app/x/route.ts", "GET"), ("service.ts", "load"), ("service.ts", "again"), ("inner.ts", "read")]
    # A check on the only way ends it; one beside it does not.
    checked = {**texts, "service.ts": texts["service.ts"].replace("  load(k)\n", "  if (row.userId !== me) no()\n")}
    assert calls.missing_authorization(sources(spark, checked)).isEmpty()
    assert calls.missing_authorization(sources(spark, {})).isEmpty()


def test_generated_trees_reach_over_several_calls(spark):
    far = {r["calls"] for r in catalogue.QUERIES["unchecked_queries"](spark, "/root/testdata/sf0.01").collect()}
    assert far >= {1, 2, 3, 4}


def test_edges_join_on_equality_only(spark):
    rows = sources(spark, {"a.ts": "function a() {\n}"})
    plan = calls.edges(calls.bodies(rows), calls.imports(rows))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
