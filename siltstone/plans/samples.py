"""Source files, paths and titles made from rows by expressions that both engines run.

Every expression is over ``event_id`` and ``h``, a number that spreads the ids, so
files differ in statements, order and names; what they contain is for the queries
and their SQL to find out, each by its own engine. An expression is a function of the
engine, as lists and lambdas are written in two ways.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import report

#: ``h`` of a row.
SPREAD = "((event_id * 48271) % 65537)"


def quoted(value: str) -> str:
    """A literal; quotes and backslashes in it by code, as engines escape them in their own ways."""
    if "'" not in value and "\\" not in value:
        return f"'{value}'"
    pieces = re.split(r"(['\\])", value)
    return "concat(" + ", ".join(f"chr({ord(p)})" if p in ("'", "\\") else f"'{p}'" for p in pieces) + ")"


def pick(items, salt):
    """One of the items, by ``h`` and the salt, which may be a name."""
    at = f"CAST(((h * ({salt} * {salt} + 3)) % 8191 + {salt}) % {len(items)} + 1 AS INT)"
    every = ", ".join(quoted(x) for x in items)
    return lambda spark: f"element_at(array({every}), {at})" if spark else f"([{every}])[{at}]"


def row(*parts):
    """A text of literals and expressions."""
    return lambda spark: "concat(" + ", ".join(p(spark) if callable(p) else p for p in parts) + ")"


def several(shapes, first: int, last: int):
    """Lines picked from the shapes, their {v} and {w} replaced by variables."""
    name = "concat('q', CAST((h * (k + 5)) % 127 % 3 AS STRING))"
    other = "concat('q', CAST((h * (k + 11)) % 131 % 5 AS STRING))"
    line = lambda spark: f"replace(replace({pick(shapes, 'k')(spark)}, '{{v}}', {name}), '{{w}}', {other})"
    return lambda spark: f"array_join(transform(sequence({first}, {last}), k -> {line(True)}), chr(10))" if spark else f"array_to_string([{line(False)} FOR k IN range({first}, {last + 1})], chr(10))"


def text(*lines):
    return lambda spark: "concat(" + ", chr(10), ".join(x(spark) if callable(x) else x for x in lines) + ")"


def by_kind(cases):
    return lambda spark: "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {x(spark)}" for k, x in enumerate(cases)) + " END"


_ID = "CAST(event_id AS STRING)"
_SCRIPT = ("{v} = request.form['key']", "{v} = request.cookies.get('seen')", "{v} = input()", "ledger.execute({v})", "os.system({v})", "{v} = sanitize({v})", "audit.note({v})", "r{v} = {v}", "ledger.execute('select 1')", "@app.get('/step/{v}')", "# {v} is read below")
_PAGE = ("const {v} = req.query.key", "let {v} = request.body.part", "var {v} = await request.json()", "store.query({v})", "execSync({v})", "const n{v} = parseInt({v})", "log.info({v})", "const r{v} = {v}", "// {v} is read below", "export function POST(req) {}")
_HEAD = ("export async function GET(req, { params }) {", "export function POST(req) {", "export async function DELETE(req, { params }) {", "function helper(req) {")
_AUTH = ("  const who = await requireAuth(req)", "  const who = null", "  const who = verifyToken(req)", "  touch(req)")
_AUTHZ = ("  if (row.ownerId !== who.id) return deny()", "  const row = null", "  touch(row)")


def _handler(salt: int) -> list:
    call = row("'  return '", pick(("loadItem", "listItem"), salt + 3), f"CAST((h + {salt}) % 5 AS STRING)", "'(req)'")
    return [pick(_HEAD, salt), pick(_AUTH, salt + 1), pick(_AUTHZ, salt + 2), call, quoted("}")]


def _service() -> list:
    name = lambda kind: row(quoted(f"export async function {kind}Item"), "CAST(h % 5 AS STRING)", quoted("(key) {"))
    one = [pick(("  return db.item.findFirst({ where: { key } })", "  return cache.get(key)"), 4), pick(("  if (row.userId !== me) throw no()", "  touch(key)", "  count(key)", "  note(key)"), 5)]
    many = pick(("  return db.item.findMany()", "  return db.item.findMany({ take: 5 })", "  return cache.all()"), 6)
    return [name("load"), *one, quoted("}"), name("list"), many, quoted("}")]


#: Conditions of a lookup of roles: by literal or variable, in any order, with and without a scope, also one nested.
_WHO = ("by: me.id", "account: { is: me.id }", "login: session.login")
_ROLE = ("role: 'ADMIN'", "role: wanted", "role: 'reader'", "role: { in: ['admin', 'root'] }", "grade: 'ADMIN'")
_SCOPE = ("", ", orgId: org", ", workspaceId: here.workspaceId", ", year: 2024")


def _roles() -> list:
    """A lookup of who has a role, its conditions in either order, and a list."""
    who, role, scope = pick(_WHO, 7), pick(_ROLE, 9), pick(_SCOPE, 11)
    first = lambda spark: f"CASE WHEN h % 2 = 0 THEN {row(who, quoted(', '), role, scope)(spark)} ELSE {row(role, scope, quoted(', '), who)(spark)} END"
    call = row(quoted("const found = await "), pick(("db.staff", "store.membership", "tx.grants"), 13), quoted(".findFirst({"))
    more = pick(("const all = await db.staff.findMany({})", "const key = jwt.read(x)", "const all = await db.staff.findMany({ skip: 1 })", "const all = await db.grants.findMany( )"), 8)
    return [call, row(quoted("  where: { "), first, quoted(" }")), quoted("})"), more]


PATH = by_kind(
    [
        row("'jobs/j'", _ID, "'.py'"),
        row("'web/w'", _ID, "'.ts'"),
        row("'shop/app/area'", "CAST(event_id % 7 AS STRING)", "'/s'", _ID, "'/[id]/route.ts'"),
        row(pick(("lib/services/item", "lib/plain/item"), 3), _ID, pick(("-service.ts", ".ts"), 3)),
        row(pick(("lib/roles", "lib/login-roles"), 2), _ID, "'.ts'"),
    ]
)
TEXT = by_kind(
    [
        text(pick(("import argparse", "import csv", "from queue import Queue"), 1), several(_SCRIPT, 2, 13)),
        text(pick(("const web = require('express')", "import { page } from 'pages'", "// no import"), 1), several(_PAGE, 2, 11)),
        text(quoted("import { db } from 'store'"), *_handler(2), *_handler(9)),
        text(*_service()),
        text(*_roles()),
    ]
)
#: Paths from folders and names.
ANY_PATH = row(pick(("tests", "src/test", "spec", "__tests__", "core", "vendor", "node_modules/kit", "dist", "docs", "testing_notes"), 3), "'/'", pick(("sheet.py", "sheet_test.go", "sheet.test.js", "sheet_spec.js", "sheet.generated.ts", "sheet.pb.go", "sheet.min.css", "Sheet.tsx"), 5))
ODD_PATH = row(pick(("../", "../../", "/", "./", "", "/repo/", "..//", "/../"), 2), "'area/'", pick(("", "../", "deep/"), 3), "'f'", _ID, "'.py'")
#: Titles: a keyword of the fixes in upper, lower or title case, or none, between words that say nothing.
TITLE = row(pick(("Note", "Report", "Case", ""), 2), "' '", lambda spark: f"CASE h % 3 WHEN 0 THEN upper({pick((*(w for w, _ in report.FIXES), 'nothing'), 3)(spark)}) ELSE {pick((*(w for w, _ in report.FIXES), 'nothing'), 3)(spark)} END", "' '", pick(("here", "there", "of part", "in step"), 5), _ID)
SECRET = by_kind([row("'key AKIA'", f"upper(substr(md5({_ID}), 1, 16))"), row("'t ghp_'", f"md5({_ID})", "'abcd'"), row("'sent Bearer '", "md5(CAST(h AS STRING))"), row("'token = \"'", "md5(CAST(h AS STRING))", "'01234567\"'"), row("'plain '", _ID)])
GUARD = text(
    pick(("import { getToken } from 'gate'", "import { pass } from 'gate'"), 2),
    pick(("export function middleware(req) {}", "const x = 1", "export default pass"), 3),
    pick(("const config = { matcher: ['/desk/:path*', \"/till\"] }", "const config = { matcher: \"/desk\" }", "const config = { matcher: [] }", "const config = {}"), 4),
)
COMMAND = pick(("./gradlew assemble", "make clean", "npm run build", "wget x", "cmake --build .", "go vet", "python setup.py"), 2)


#: Scripts whose values pass through several variables.
_CHAIN = ("{v} = request.form['key']", "{w} = wrap({v})", "{w} = {v}", "{w} += {v}", "{v} = 'fixed'", "{w} = pad({w}, {v})", "ledger.execute({v})", "os.system(pad({w}))", "{v} = sanitize({v})", "note({v}, {w})", "{w} = {v} if {w} else 0", "if {v} == {w}:", "{v} = {w}")
CHAIN_PATH = row("'flows/f'", _ID, "'.py'")
CHAIN = several(_CHAIN, 2, 31)

#: Three files of a row that call each other: handlers, what they import, and what that imports. Functions have the same
#: names in every row; checks, queries, import forms and calls differ.
_CHECKS = ("  if (row.ownerId !== me) return deny()", "  touch({ key: '}' })", "  note(key) // }", "  if (key) {\n    touch(key)\n  }")
_OWN = "'e'", _ID
CALLER_PATH = row("'shop/app/'", *_OWN, "'/route.ts'")
CALLED_PATH = row("'lib/stock/'", *_OWN, pick((".ts", "/index.ts"), 3))
INNER_PATH = row("'lib/rows/'", *_OWN, "'.ts'")
CALLER = text(
    row(pick(("import { loadPart as fetchPart, dropPart } from '@/lib/stock/", "import { loadPart as fetchPart, dropPart } from '../../../lib/stock/", "import { loadPart as fetchPart, dropPart } from 'stock/"), 2), *_OWN, quoted("'")),
    quoted("export async function GET(req, { params }) {"),
    pick(_CHECKS, 4),
    pick(("  return fetchPart(params.id)", "  return loadPart(params.id)", "  return show(req)"), 5),
    quoted("}"),
    quoted("function show(req) {"),
    pick(_CHECKS, 6),
    pick(("  return dropPart(req)", "  return fetchPart(req)", "  return show(req)"), 7),
    quoted("}"),
    pick(("export function DELETE(req) { return dropPart(req) }", "export const DELETE = async (req) => {\n  return dropPart(req)\n}", "export const other = 1"), 8),
)
CALLED = text(
    row(pick(("import * as rows from '", "import rows from '"), 9), pick(("@/lib/rows/", "@/lib/none/"), 10), *_OWN, quoted("'")),
    quoted("export async function loadPart(key) {"),
    pick(_CHECKS, 11),
    pick(("  return rows.read(key)", "  return read(key)", "  return db.part.findFirst({ where: { key } })", "  return dropPart(key)"), 12),
    quoted("}"),
    quoted("export async function dropPart(key) {"),
    pick(_CHECKS, 13),
    pick(("  return rows.drop(key)", "  return cache.drop(key)", "  return loadPart(key)"), 14),
    quoted("}"),
)
INNER = text(
    *(x for name, k in (("read", 15), ("drop", 17)) for x in (quoted(f"export function {name}(key) {{"), pick(_CHECKS, k), pick((f"  return db.part.{name}(key)", f"  return cache.{name}(key)"), k + 1), quoted("}"))),
)

#: Diffs of one or two files of a finding's row: hunks near its line, new, deleted, renamed and plain ones.
_EDIT = ("+new {v}", " same {v}", "-old {v}", "+more {v}", "+", "", "-", "+++ {v}", "-- {v}", "\\ No newline at end of file", " @@ {v}", "+diff {v}")
_SIDE = {
    0: ("'diff --git a/', file, ' b/', file, chr(10), 'index 1..2 100644', chr(10), '--- a/', file, chr(10), '+++ b/', file"),
    1: ("'diff --git a/', file, ' b/', file, chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/', file"),
    2: ("'diff --git a/', file, ' b/', file, chr(10), 'deleted file mode 100644', chr(10), '--- a/', file, chr(10), '+++ /dev/null'"),
    3: ("'diff --git a/old/', file, ' b/', file, chr(10), 'similarity index 90%', chr(10), 'rename from old/', file, chr(10), 'rename to ', file, chr(10), '--- a/old/', file, chr(10), '+++ b/', file"),
}
_HUNK = lambda spark, at: f"chr(10), '@@ -', CAST({at} AS STRING), ',4 +', CAST({at} AS STRING), ',9 @@ part', chr(10), "
_HEADS = lambda: "CASE event_id % 4 " + " ".join(f"WHEN {k} THEN concat({x})" for k, x in _SIDE.items()) + " END"
DIFF = lambda spark: (
    f"concat('commit ', {_ID}, chr(10), chr(10), '    message', chr(10), {_HEADS()}, {_HUNK(spark, 'start_line')}{several(_EDIT, 2, 9)(spark)}, {_HUNK(spark, 'start_line + 300')}{several(_EDIT, 10, 15)(spark)}, chr(10),"
    f" 'diff --git a/kept/', {_ID}, '.md b/kept/', {_ID}, '.md', chr(10), 'similarity index 100%', chr(10), 'rename from kept/', {_ID}, '.md', chr(10), 'rename to moved/', {_ID}, '.md', chr(10))"
)


def made(rows: DataFrame, *kept: str, **values) -> DataFrame:
    """(kept.., values..) of rows with an ``event_id``."""
    return rows.withColumn("h", F.expr(SPREAD)).select(*kept, *(F.expr(v(True)).alias(k) for k, v in values.items()))


def duck(expression, rows: str = "f") -> str:
    """A table of event_id and ``value``, the expression in the other engine's SQL."""
    return f"(SELECT event_id, {expression(False).replace('AS STRING', 'AS VARCHAR')} AS value FROM (SELECT *, {SPREAD} AS h FROM {rows}))"


#: c: the files; cl: their lines.
FILES = f"c AS (SELECT p.event_id, p.value AS path, t.value AS text FROM {duck(PATH)} p JOIN {duck(TEXT)} t USING (event_id))"
FILE_LINES = "cl AS (SELECT event_id, path, i::INT AS line, ls[i] AS text, len(ls) AS n FROM (SELECT event_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT event_id, path, string_split(text, chr(10)) AS ls FROM c)))"
