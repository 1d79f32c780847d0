"""Calls between functions of a source tree: bodies by bracket depth, calls by import path, and what handlers reach.

Files are TypeScript or JavaScript, one row each (path, text). Functions, imports and
calls come from expressions over each file alone; edges are equality joins on
(path, name), and reached functions grow by a call a round until none is new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators.detect import AUTHZ_TEXTS, DATABASE
from siltstone.scratch import discard, settle

#: What opens a function: its name stands in the first group, or the second if an arrow follows.
HEAD = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|\w+\s*=>))"
CALL = r"([A-Za-z_$](?<![\w.].)(?<!function .)(?<!function\* .)[\w$]*+(?:\.[A-Za-z_$][\w$]*+)?+)\s*+\("
IMPORT = r"""import\s+(?:type\s+)?([^'";]+?)\s+from\s+['"]([^'"]+)['"]"""
REQUIRE = r"""(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]"""
ROUTE = r"(^|/)route\.[jt]sx?$"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
#: Extensions of a module, the preferred first.
EXTENSIONS = ("ts", "tsx", "js", "jsx")
#: White space and line ends within a line; a line ends at ``\n`` alone.
_GAP, _TURN = r"[ \t\x0B\f]", r"\n\r\u0085\u2028\u2029"
_QUOTED = rf"""(?=['"`/])(?:'(?:[^'\\\n]|\\[^{_TURN}])*+'|"(?:[^"\\\n]|\\[^{_TURN}])*+"|`[^`\n]*+`|//[^{_TURN}]*+(?=[\u0085\u2028\u2029]?(?:\n|\z)))"""
#: HEAD in each line of a text: groups for ``export``, ``default`` and the two names.
_HEADS = rf"(?md)^{HEAD.lstrip('^')}".replace(r"(?:export\s+)?(?:default\s+)?", r"(export\s+)?(default\s+)?").replace("[^()]", r"[^()\n]").replace("[^=]", r"[^=\n]").replace(r"\s", _GAP)
_ENDS = rf"(?md)[}};]{_GAP}*[),;]*{_GAP}*[\u0085\u2028\u2029]?$"
#: Signs that stand before the parts of a head and at the end of a line where a body may end.
_AT_HEAD, _AT_END = "\x01", "\x02"
_FOUND = "array<struct<name:string,main:boolean,first:int,depth:int>>"
_DONE = "array<struct<name:string,main:boolean,first:int,last:int>>"
_STATE = f"struct<depth:int,open:{_FOUND},done:{_DONE}>"


def _every(column: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _outline(text: Column) -> Column:
    """What the fold needs of each line: its brackets, the head that it is, and whether a body may end there; most lines are empty.

    The text is read whole, as a pattern tried on each line costs much more.
    """
    quoted = text.contains("'") | text.contains('"') | text.contains("`") | text.contains("//")
    bare = F.when(quoted, F.regexp_replace(text, _QUOTED, "")).otherwise(text)
    bare = F.replace(F.replace(bare, F.lit(_AT_HEAD), F.lit("\x03")), F.lit(_AT_END), F.lit("\x03"))
    headed = F.regexp_replace(bare, _HEADS, f"{_AT_HEAD}$3$4{_AT_HEAD}$1$2{_AT_HEAD}$0")
    ended = F.regexp_replace(headed, _ENDS, f"$0{_AT_END}")
    kept = F.regexp_replace(ended, rf"({_AT_HEAD}\w*+{_AT_HEAD}[^{_AT_HEAD}]*+{_AT_HEAD})|[^\n{_AT_HEAD}{_AT_END}(\[{{)\]}}]++", "$1")
    return F.replace(kept, F.lit("()"), F.lit(""))


def _mark(line: Column, at: Column) -> Column:
    """A line of the outline: its number, by how much it opens brackets, the function whose head it is, and whether a body may end there."""
    opened = F.length(F.translate(line, ")]}", "")) - F.length(F.translate(line, "([{", ""))
    mark = lambda name, main: F.struct(at.alias("at"), opened.alias("opened"), name.alias("name"), main.alias("main"), line.contains(_AT_END).alias("ends"))
    head = _let(F.split(line, _AT_HEAD), lambda part: mark(part[1], part[2].startswith("export") & part[2].contains("default")))
    return F.when(line.startswith(_AT_HEAD), head).otherwise(mark(F.lit(""), F.lit(False)))


def _spans(lines: Column) -> Column:
    """(name, main, first, last) of the functions in the lines of an outline, nested ones too."""

    def state(depth: Column, opened: Column, done: Column) -> Column:
        return F.struct(depth.alias("depth"), opened.alias("open"), done.alias("done"))

    def closed(functions: Column, last: Column) -> Column:
        return F.transform(functions, lambda f: F.struct(f["name"].alias("name"), f["main"].alias("main"), f["first"].alias("first"), last.alias("last")))

    def step(s: Column, m: Column) -> Column:
        at, depth = m["at"], s["depth"] + m["opened"]
        head = F.struct(m["name"].alias("name"), m["main"].alias("main"), at.alias("first"), s["depth"].alias("depth"))
        every = F.when(m["name"] != "", F.concat(s["open"], F.array(head))).otherwise(s["open"])
        # A body ends where its brackets are closed again; a head alone on its lines has not begun.
        ends = lambda f: (depth <= f["depth"]) & (m["ends"] | (depth < f["depth"]))
        left = lambda fs: F.when(F.exists(fs, ends), state(depth, F.filter(fs, lambda f: ~ends(f)), F.concat(s["done"], closed(F.filter(fs, ends), at)))).otherwise(state(depth, fs, s["done"]))
        idle = (m["name"] == "") & (F.size(s["open"]) == 0)
        return F.when(idle, state(depth, s["open"], s["done"])).otherwise(_let(every, left))

    begin = F.struct(F.lit(0).alias("depth"), F.array().cast(_FOUND).alias("open"), F.array().cast(_DONE).alias("done")).cast(_STATE)
    # An empty line changes nothing. What the text leaves open ends with it.
    marks = F.filter(F.transform(lines, lambda line, i: F.when(line != "", _mark(line, i + 1))), lambda m: m.isNotNull())
    return F.aggregate(marks, begin, step, lambda s: F.concat(s["done"], closed(s["open"], F.size(lines))))


def _firsts(functions: Column) -> Column:
    """The first function of each name."""
    some = F.size(F.array_distinct(F.transform(functions, lambda f: f["name"]))) < F.size(functions)
    return F.when(some, F.filter(functions, lambda f: ~F.exists(functions, lambda g: (g["name"] == f["name"]) & (g["first"] < f["first"])))).otherwise(functions)


def bodies(files: DataFrame) -> DataFrame:
    """(path, name, is_default, first, last, has_check, has_query, calls): the functions of each file (one row a path).

    A function is a declaration or an arrow or function expression that a variable gets; its body reaches to
    where the brackets of its head are closed again, brackets in quotes and line comments
    aside. Block comments, regular expressions and templates over lines are read as code. ``calls``
    are the names called in it, with the name before a dot; a nested function's are also its outer one's. Of
    equal names in a file the first counts. Null texts have none. One pass over the files, without a shuffle.
    """
    f = F.col("f")
    return _functions(files).select("path", F.explode("functions").alias("f")).select("path", f["name"].alias("name"), f["is_default"].alias("is_default"), f["first"].alias("first"), f["last"].alias("last"), f["has_check"].alias("has_check"), f["has_query"].alias("has_query"), f["calls"].alias("calls"))


def _functions(files: DataFrame, *kept: str) -> DataFrame:
    """(path, kept.., functions) of files that have functions: what ``bodies`` gives, as an array."""
    # What a generator makes is made once.
    whole = files.filter(F.col("text").contains("function") | F.col("text").contains("=>")).select("path", *kept, F.explode(F.array(F.replace("text", F.lit("\r"), F.lit("")))).alias("text"))
    rows = whole.select("path", *kept, F.split("text", "\n").alias("lines"), F.explode(F.array(F.split(_outline(F.col("text")), "\n"))).alias("outline"))
    found = rows.select("path", *kept, "lines", F.explode(F.array(_spans(F.col("outline")))).alias("every")).filter(F.size("every") > 0)

    def said(f: Column, body: Column) -> Column:
        check = reduce(Column.__or__, [body.contains(x) for x in AUTHZ_TEXTS])
        query = (body.contains("db.") | body.contains("prisma.")) & body.rlike(DATABASE)
        return F.struct(f["name"].alias("name"), f["main"].alias("is_default"), f["first"].alias("first"), f["last"].alias("last"), check.alias("has_check"), query.alias("has_query"), F.array_distinct(_every(body, CALL)).alias("calls"))

    body = lambda f: F.array_join(F.slice("lines", f["first"], f["last"] - f["first"] + 1), "\n")
    first = found.select("path", *kept, "lines", F.explode(F.array(_firsts(F.col("every")))).alias("every"))
    return first.select("path", *kept, F.transform("every", lambda f: _let(body(f), lambda b: said(f, b))).alias("functions"))


def module(path: Column) -> Column:
    """What imports say for a file: no extension, no ``index``."""
    return F.regexp_replace(F.regexp_replace(path, rf"\.({'|'.join(EXTENSIONS)})$", ""), r"(^|/)index$", "")


def imports(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(path, local, module, name): what each file imports under which name; ``*`` for a whole module, ``default`` for its main export.

    Modules are relative to the importing file, or start with one of ``aliases`` (by default
    ``@/``, the top folder); of packages and paths that leave the tree ``module`` is null.
    """
    return files.select("path", F.explode(_imports(F.col("path"), F.col("text"), aliases)).alias("i")).select("path", "i.*")


def _imports(path: Column, text: Column, aliases: dict[str, str] | None) -> Column:
    """(local, module, name) of each import of a file, as an array."""
    none = F.array().cast("array<struct<clause:string,source:string,required:boolean>>")

    def clauses(word: str, pattern: str) -> Column:
        every = F.arrays_zip(_every(text, pattern, 1).alias("clause"), _every(text, pattern, 2).alias("source"))
        return F.when(text.contains(word), F.transform(every, lambda c: F.struct(c["clause"].alias("clause"), c["source"].alias("source"), F.lit(pattern == REQUIRE).alias("required")))).when(text.isNotNull(), none)

    def home(source: Column) -> Column:
        near = F.when(source.rlike(r"^\.\.?(/|$)"), F.concat_ws("/", F.regexp_replace(path, r"/?[^/]*$", ""), source))
        for prefix, folder in ({"@/": ""} if aliases is None else aliases).items():
            near = near.when(source.startswith(prefix), F.concat(F.lit(folder), F.substr(source, F.lit(len(prefix) + 1))))
        return module(paths.resolved(near))

    def names(clause: Column, required: Column) -> Column:
        inner = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"^type\s+", "")), lambda x: x != "")
        named = F.transform(inner, lambda x: F.struct(F.regexp_extract(x, r"(\w+)$", 1).alias("local"), F.regexp_extract(x, r"^(\w+)", 1).alias("name")))
        whole = F.coalesce(F.nullif(F.regexp_extract(clause, r"\*\s*as\s+(\w+)", 1), F.lit("")), F.when(required, F.nullif(F.regexp_extract(clause, r"^(\w+)$", 1), F.lit(""))))
        main = F.when(~required, F.nullif(F.regexp_extract(clause, r"^(\w+)", 1), F.lit("")))
        return F.concat(named, F.filter(F.array(F.struct(whole.alias("local"), F.lit("*").alias("name")), F.struct(main.alias("local"), F.lit("default").alias("name"))), lambda x: x["local"].isNotNull()))

    said = lambda c: _let(home(c["source"]), lambda to: F.transform(names(F.trim(c["clause"]), c["required"]), lambda n: F.struct(n["local"].alias("local"), to.alias("module"), n["name"].alias("name"))))
    return F.flatten(F.transform(F.concat(clauses("import", IMPORT), clauses("require", REQUIRE)), said))


def edges(functions: DataFrame, imported: DataFrame) -> DataFrame:
    """(path, name, to_path, to_name): the calls of functions (as of ``bodies``) to functions of the tree.

    A name that a file imports is the imported one, else its own function; of files that are the
    same module the first by extension counts. Other names have no edge.
    """
    calls = functions.select("path", "name", F.explode("calls").alias("call"))
    calls = calls.select("path", "name", F.regexp_extract("call", r"^(?:(.*)\.)?(.*)$", 1).alias("owner"), F.regexp_extract("call", r"(\w+)$", 1).alias("called"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("path", r"\.(\w+)$", 1)), F.lit(9))
    homes = functions.select("path").distinct().groupBy(module(F.col("path")).alias("module")).agg(F.min_by("path", F.struct(rank, "path")).alias("to_path"))
    # Whether a file imports the name decides, not whether the module was found; packages, of no module, are spread by path.
    key = F.coalesce("module", F.concat(F.lit("\0"), "path"))
    names = imported.withColumn("module", key).join(homes, "module", "left").groupBy("path", "local").agg(F.min(F.when(F.col("to_path").isNotNull(), F.struct("to_path", F.col("name").alias("to_name")))).alias("to"))
    said = calls.withColumn("local", F.when(F.col("owner") == "", F.col("called")).otherwise(F.col("owner"))).join(names.withColumn("imported", F.lit(True)), ["path", "local"], "left")
    plain, whole = F.col("owner") == "", F.col("to.to_name") == "*"
    to = F.when(F.col("imported") & plain & ~whole, F.col("to")).when(F.col("imported") & ~plain & whole, F.struct(F.col("to.to_path").alias("to_path"), F.col("called").alias("to_name")))
    to = to.when(F.col("imported").isNull() & plain, F.struct(F.col("path").alias("to_path"), F.col("called").alias("to_name")))
    found = said.select("path", "name", to.alias("to")).filter("to is not null").select("path", "name", "to.to_path", F.col("to.to_name").alias("said"))
    # A function goes by its name, and a main export by ``default`` too.
    ends = functions.select(F.col("path").alias("to_path"), F.col("name").alias("said"), F.col("name").alias("to_name"))
    mains = functions.filter("is_default").groupBy(F.col("path").alias("to_path")).agg(F.min_by("name", "first").alias("to_name")).select("to_path", F.lit("default").alias("said"), "to_name")
    return found.join(ends.unionByName(mains), ["to_path", "said"]).select("path", "name", "to_path", "to_name").distinct()


def _resolved(files: DataFrame, aliases: dict[str, str] | None) -> DataFrame:
    """(path, module, functions) of files that have functions: ``name``, ``has_check``, ``has_query``, and what their calls may lead to without another file.

    ``main`` says whether ``default`` means the function. ``own`` has the functions of the file that it calls and
    that do not check, ``out`` what it calls by an import: ``local``, ``called`` and the (``module``, ``name``) that
    the file imports as it. A function that checks has neither.
    """
    rows = _functions(files.select("path", "text", _imports(F.col("path"), F.col("text"), aliases).alias("imports")), "imports")
    rows = rows.select("path", F.explode(F.array(F.struct("functions", "imports"))).alias("r")).select("path", "r.*")

    def split(call: Column) -> Column:
        return F.struct(F.when(call.contains("."), F.substring_index(call, ".", 1)).otherwise("").alias("owner"), F.when(call.contains("$"), F.regexp_extract(call, r"(\w+)$", 1)).otherwise(F.substring_index(call, ".", -1)).alias("called"))

    def out(c: Column) -> Column:
        local = F.when(c["owner"] == "", c["called"]).otherwise(c["owner"])
        met = F.filter("imports", lambda i: i["local"] == local)
        return F.transform(met, lambda i: F.struct(local.alias("local"), c["owner"].alias("owner"), c["called"].alias("called"), i["module"].alias("module"), i["name"].alias("name"), (F.size(met) > 1).alias("again")))

    def one(f: Column, calls: Column) -> Column:
        before = F.exists("functions", lambda g: g["is_default"] & (g["first"] < f["first"]))
        called = lambda g: F.exists(calls, lambda c: (c["owner"] == "") & (c["called"] == g["name"])) & ~F.exists("imports", lambda i: i["local"] == g["name"])
        own = F.transform(F.filter("functions", lambda g: ~g["has_check"] & called(g)), lambda g: g["name"])
        parts = (f["name"].alias("name"), f["has_check"].alias("has_check"), f["has_query"].alias("has_query"), (f["is_default"] & ~before).alias("main"))
        return F.struct(*parts, F.when(~f["has_check"], own).alias("own"), F.when(~f["has_check"], F.flatten(F.transform(calls, out))).alias("out"))

    return rows.select("path", module(F.col("path")).alias("module"), F.transform("functions", lambda f: _let(F.transform(f["calls"], split), lambda calls: one(f, calls))).alias("functions"))


def _open_links(known: DataFrame) -> DataFrame:
    """(path, name, to_path, to_name) as of ``edges``, between functions (of ``_resolved``) that do not check; some more than once.

    Calls meet files on their module alone, once; calls of a name that a file imports more than once are told apart after it.
    """
    rows = known.select("path", F.explode("functions").alias("f")).filter("not f.has_check")
    own = rows.select("path", "f.name", F.col("path").alias("to_path"), F.explode("f.own").alias("to_name"))
    # Of files that are the same module the first by extension counts, whether or not its functions check.
    ends = F.transform(F.filter("functions", lambda f: ~f["has_check"]), lambda f: F.struct(f["name"].alias("name"), f["main"].alias("main")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("path", r"\.(\w+)$", 1)), F.lit(9))
    homes = known.select("module", F.struct(rank.alias("rank"), "path", ends.alias("ends")).alias("home")).groupBy("module").agg(F.min("home").alias("home"))
    sent = rows.select("path", "f.name", F.explode("f.out").alias("o")).filter("o.module is not null")
    met = sent.withColumn("module", F.col("o.module")).join(homes, "module").select("path", "name", "o", F.struct(F.col("home.path").alias("to_path"), F.col("o.name").alias("to_name"), F.col("home.ends").alias("ends")).alias("to"))
    once = met.filter("not o.again").select("path", "name", "o.owner", "o.called", "to")
    again = met.filter("o.again").groupBy("path", "name", "o.local", "o.owner", "o.called").agg(F.min("to").alias("to")).select("path", "name", "owner", "called", "to")
    plain, whole = F.col("owner") == "", F.col("to.to_name") == "*"
    said = F.when(plain & ~whole, F.col("to.to_name")).when(~plain & whole, F.col("called"))
    every = once.unionByName(again).select("path", "name", F.col("to.to_path").alias("to_path"), said.alias("said"), F.col("to.ends").alias("ends"))
    meant = F.filter("ends", lambda e: (e["name"] == F.col("said")) | (e["main"] & (F.col("said") == "default")))
    return own.unionByName(every.select("path", "name", "to_path", F.explode(F.transform(meant, lambda e: e["name"])).alias("to_name")))


def reached(links: DataFrame, roots: DataFrame, calls: int | None = None) -> DataFrame:
    """(root_path, root_name, path, name, calls, trail): the functions that each root (path, name) reaches, itself among them.

    ``trail`` has the (path, name) on the shortest way, the first in order of equally short ones. Cycles end, as a
    function is reached once a root. Rounds are as many as the longest way, at most ``calls``. The
    tables of the rounds stay, as the result reads them.
    """
    on = settle(links, "call-edges")
    here = F.struct("path", "name")
    frontier = settle(roots.select(F.col("path").alias("root_path"), F.col("name").alias("root_name"), "path", "name", F.array(here).alias("trail")), "call-reached", few=True)
    seen, done = frontier, 0
    while calls is None or done < calls:
        more = frontier.join(on, ["path", "name"]).select("root_path", "root_name", F.col("to_path").alias("path"), F.col("to_name").alias("name"), "trail")
        more = more.groupBy("root_path", "root_name", "path", "name").agg(F.min("trail").alias("trail")).withColumn("trail", F.concat("trail", F.array(here)))
        frontier = settle(more.join(seen, ["root_path", "root_name", "path", "name"], "left_anti"), "call-reached", few=True)
        if frontier.isEmpty():
            discard(frontier)
            break
        done += 1
        seen = seen.unionByName(frontier)
    discard(on)
    return seen.select("root_path", "root_name", "path", "name", (F.size("trail") - 1).alias("calls"), "trail")


def missing_authorization(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(path, method, to_path, to_name, calls, trail, cwe): request handlers that reach a query of the database in another function, no function on the way checking who owns the row.

    Handlers are the functions named after a method in route files. A function that checks is not gone
    through. Unlike ``detect.missing_authorization``, which goes by name and by file, this tells functions of equal
    names apart and follows any number of calls.
    """
    known = settle(_resolved(files, aliases), "functions")
    functions = known.select("path", F.explode("functions").alias("f")).select("path", "f.*")
    open_ = functions.filter("not has_check").select("path", "name")
    handlers = open_.filter(F.col("path").rlike(ROUTE) & F.col("name").isin(*METHODS))
    found = reached(_open_links(known), handlers).filter("calls > 0")
    queries = functions.filter("has_query").select("path", "name")
    return found.join(queries, ["path", "name"], "left_semi").select(
        F.col("root_path").alias("path"), F.col("root_name").alias("method"), F.col("path").alias("to_path"), F.col("name").alias("to_name"), "calls", "trail", F.lit("CWE-862").alias("cwe")
    )
