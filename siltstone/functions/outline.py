"""Entries of indented configuration text: a fold over its lines with a stack of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = r"""^["']?([\w.$/-]+)["']?\s*:(?:\s+(.*))?$"""
_QUOTED = r"""^(["'])(.*)\1\s*(?:#.*)?$"""
_STATE = "struct<stack:array<struct<indent:int,key:string,n:int>>,block:int,done:array<struct<key:string,value:string>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def entries(text: Column) -> Column:
    """Array of (key, value) in order: ``rules[0].metadata.cwe[1]`` and what stands there, without quotes and comments.

    Keys nest by indentation; a dash opens an item of the list above it, also at the same
    indentation. Lines of a block scalar (``|``, ``>``) are no entries, and neither are empty values,
    comments and document marks; flow style is a value as it stands. Without text there are none.
    """
    indent_of = lambda line: F.length(line) - F.length(F.ltrim(line))
    entry = lambda indent, key, n: F.struct(indent.cast("int").alias("indent"), key.alias("key"), n.cast("int").alias("n"))

    def path(stack: Column) -> Column:
        return F.regexp_replace(F.array_join(F.transform(stack, lambda e: F.coalesce(e["key"], F.concat(F.lit("["), e["n"].cast("string"), F.lit("]")))), "."), r"\.\[", "[")

    def state(stack: Column, block: Column, done: Column) -> Column:
        return F.struct(stack.alias("stack"), block.cast("int").alias("block"), done.alias("done")).cast(_STATE)

    def bare(value: Column) -> Column:
        """Without a comment; signs in quotes are none."""
        return F.when(value.rlike(_QUOTED), F.regexp_replace(value, _QUOTED, "$1$2$1")).otherwise(F.trim(F.regexp_replace(value, r"(^|\s)#.*$", "")))

    def placed(s: Column, stack: Column, indent: Column, rest: Column) -> Column:
        """A key or a plain value below ``stack``."""
        key, value = F.regexp_extract(rest, _KEY, 1), bare(F.trim(F.regexp_extract(rest, _KEY, 2)))
        said = lambda at, v: F.concat(s["done"], F.array(F.struct(path(at).alias("key"), F.regexp_replace(bare(v), _QUOTED, "$2").alias("value"))))
        none = F.lit(None)

        def keyed(below: Column) -> Column:
            return (
                F.when(value.rlike(r"^[|>][0-9+-]*$"), state(below, indent, s["done"]))
                .when(value == "", state(below, none, s["done"]))
                .otherwise(state(below, none, said(below, value)))
            )

        return F.when(key != "", _let(F.concat(stack, F.array(entry(indent, key, F.lit(None)))), keyed)).otherwise(state(stack, none, F.when(rest == "", s["done"]).otherwise(said(stack, rest))))

    def line_in(s: Column, line: Column) -> Column:
        indent, body = indent_of(line), F.trim(line)
        # A dash is not above a key of its own indentation, but ends the item before it.
        kept = F.filter(s["stack"], lambda e: (e["indent"] < indent) | ((e["indent"] == indent) & e["n"].isNull()))
        n = F.coalesce(F.get(F.filter(s["stack"], lambda e: (e["indent"] == indent) & e["n"].isNotNull()), 0)["n"] + 1, F.lit(0))
        item = _let(F.concat(kept, F.array(entry(indent, F.lit(None).cast("string"), n))), lambda stack: placed(s, stack, indent + F.length(F.regexp_extract(body, r"^(-\s*)", 1)), F.regexp_replace(body, r"^-\s*", "")))
        plain = _let(F.filter(s["stack"], lambda e: e["indent"] < indent), lambda stack: placed(s, stack, indent, body))
        return F.when(body.rlike(r"^-(\s|$)"), item).otherwise(plain)

    def step(s: Column, line: Column) -> Column:
        idle = line.rlike(r"^\s*(#.*)?$|^(---|\.\.\.)\s*$") | (s["block"].isNotNull() & (indent_of(line) > s["block"]))
        return F.when(idle, s).otherwise(line_in(s, line))

    begin = state(F.array().cast("array<struct<indent:int,key:string,n:int>>"), F.lit(None), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(F.split(F.regexp_replace(text, "\r", ""), "\n"), begin, step, lambda s: s["done"])
