"""Flat YAML records by column expressions: one list item of scalars and one list per row, no loader.

A record's keys stand in one column, and whatever belongs to a key stands deeper (list items may stand as deep as the key),
so its lines fall into groups by their indent alone. Scalars may be plain, quoted, or literal (``|``) and folded (``>``)
blocks; lists may be block or flow. Plain scalars keep their text as written, numbers included. Anchors, tags, nested
mappings and documents are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import let

_KEY = r"^[\"']?([\w-]+)[\"']?[ \t]*:(?:[ \t]+(.*))?$"
_SINGLE = r"(?s)^'([^']*+(?:''[^']*+)*+)'"
_DOUBLE = r"(?s)^\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\""
_FLOW_ITEM = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^']*+(?:''[^']*+)*+'|[^,\s][^,]*"
_NULLS = ["", "~", "null", "Null", "NULL"]
_FAR = 1 << 30


def _leading(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def _folded(lines: Column) -> Column:
    """Lines of a flow scalar: a line break is a blank, of several in a row the first is dropped."""
    joined = F.array_join(F.transform(lines, lambda v: F.trim(v, F.lit(" \t"))), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")


def _unescaped(body: Column) -> Column:
    """Text of a double-quoted scalar; its escapes are those of JSON and ``\\x``."""
    text = F.regexp_replace(body, r"((?<!\\)(?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    text = F.regexp_replace(F.regexp_replace(text, r"((?<!\\)(?:\\\\)*)\\ ", "$1 "), "\n", r"\\n")
    read = F.from_json(F.concat(F.lit('{"v":"'), F.replace(text, F.lit("\t"), F.lit(r"\t")), F.lit('"}')), "v string")["v"]
    return F.coalesce(read, body)


def _plain(lines: Column) -> Column:
    text = _folded(F.transform(lines, lambda v: F.regexp_replace(v, r"(?:^|[ \t])#.*$", "")))
    text = F.trim(text, F.lit(" \t\n"))
    return F.when(~text.isin(*_NULLS), text)


def _block(head: Column, rest: Column) -> Column:
    """Literal or folded block with its indent and end rule."""
    given = F.regexp_extract(head, r"^[|>][+-]?([1-9])", 1).try_cast("int")
    full = F.filter(rest, lambda v: F.trim(v) != "")
    depth = F.coalesce(given, F.when(F.size(full) > 0, _leading(F.element_at(full, 1))), F.lit(0))
    body = let(depth, lambda d: F.transform(F.filter(rest, lambda v: (F.trim(v) == "") | (_leading(v) >= d)), lambda v: F.substring(v, d + 1, F.lit(_FAR))))
    text = F.array_join(body, "\n")
    one = F.regexp_replace(text, r"(?m)^([^\n \t][^\n]*)\n(?=[^\n \t])", "$1 ")
    folded = F.regexp_replace(one, r"(?m)^([^\n \t][^\n]*)\n(\n+)(?=[^\n \t])", "$1$2")
    text = F.when(F.startswith(head, F.lit(">")), folded).otherwise(text)
    ended = F.regexp_replace(text, r"\n+\z", "")
    mark = F.regexp_extract(head, r"^[|>]([1-9+-]*)", 1)
    return F.when(F.contains(mark, F.lit("+")), F.concat(text, F.lit("\n"))).when(F.contains(mark, F.lit("-")) | (ended == ""), ended).otherwise(F.concat(ended, F.lit("\n")))


def scalar(first: Column, rest: Column, block: bool = True) -> Column:
    """Value of a scalar that begins behind its key and goes on in the lines ``rest``; null if it is null or missing.

    ``block=False`` where it cannot be a block, as in a flow list.
    """
    head = F.trim(F.coalesce(first, F.lit("")), F.lit(" \t"))
    lines = F.concat(F.array(head), rest)
    folded = _folded(lines)
    flow = (
        F.when(F.startswith(head, F.lit("'")), F.replace(F.regexp_extract(folded, _SINGLE, 1), F.lit("''"), F.lit("'")))
        .when(F.startswith(head, F.lit('"')), _unescaped(F.regexp_extract(folded, _DOUBLE, 1)))
        .otherwise(_plain(lines))
    )
    return F.when(head.rlike(r"^[|>][1-9+-]*(?:[ \t]+#.*)?$"), _block(head, rest)).otherwise(flow) if block else flow


def listed(first: Column, rest: Column) -> Column:
    """Values of a block or flow list, without its null items; null where the value is no list."""
    head = F.trim(F.coalesce(first, F.lit("")), F.lit(" \t"))
    none = F.array().cast("array<string>")
    flow = F.regexp_extract(_folded(F.concat(F.array(head), rest)), r"(?s)^\[(.*)\]", 1)
    flowed = F.transform(F.regexp_extract_all(flow, F.lit(_FLOW_ITEM), F.lit(0)), lambda v: scalar(F.trim(v), none, block=False))
    text = F.array_join(rest, "\n")
    pieces = F.split(text, r"(?m)^[ \t]*-(?:[ \t]+|$)")
    block = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: let(F.split(p, "\n"), lambda v: scalar(v[0], F.slice(v, 2, F.size(v)))))
    bare = head.rlike(r"^(?:#.*)?$")
    found = F.when(F.startswith(head, F.lit("[")), flowed).when(bare & (F.size(pieces) > 1), block)
    return F.filter(found, lambda v: v.isNotNull())


def record(piece: Column, indent: Column | int, scalars: Sequence[str], lists: Sequence[str]) -> Column:
    """Struct of the wanted fields of one list item, whose ``- `` stood behind ``indent`` blanks and has been cut off.

    Of a repeated key the last counts. A line less deep than the keys ends the record.
    """
    first = _leading(piece)  # blanks between the dash and the first key
    column = (F.lit(indent) if isinstance(indent, int) else indent) + 2 + first
    raw = F.split(F.regexp_replace(F.ltrim(piece), r"\r(?=\n|$)", ""), "\n")

    def grouped(lines: Column, depth: Column) -> Column:
        blank = lambda v: v.rlike(r"^[ \t]*(?:#.*)?$")
        ends = F.filter(F.transform(lines, lambda v, i: F.when((i > 0) & ~blank(v) & (_leading(v) < depth), i)), lambda i: i.isNotNull())
        own = F.slice(lines, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(lines)))
        cut = F.transform(own, lambda v, i: F.when(i == 0, v).when(_leading(v) >= depth, F.substring(v, depth + 1, F.lit(_FAR))).otherwise(F.ltrim(v)))
        return cut

    def fields(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda v, i: F.when(v.rlike(_KEY), i)), lambda i: i.isNotNull())

        def group(i: Column, k: Column, starts: Column) -> Column:
            to = F.coalesce(F.get(starts, k + 1), F.size(lines))
            line = F.get(lines, i)
            return F.struct(
                F.regexp_extract(line, _KEY, 1).alias("key"),
                F.regexp_extract(line, _KEY, 2).alias("first"),
                F.slice(lines, i + 2, to - i - 1).alias("rest"),
            )

        return let(at, lambda starts: F.transform(starts, lambda i, k: group(i, k, starts)))

    groups = let(let(F.struct(raw.alias("lines"), column.alias("depth")), lambda s: grouped(s["lines"], s["depth"])), fields)
    values = lambda g: F.struct(
        g["key"].alias("key"),
        F.when(g["key"].isin(*scalars), scalar(g["first"], g["rest"])).alias("one"),
        F.when(g["key"].isin(*lists), listed(g["first"], g["rest"])).alias("many"),
    )
    last = lambda all_, name: F.try_element_at(F.filter(all_, lambda g: g["key"] == name), F.lit(-1))
    pick = lambda all_: F.struct(*[last(all_, f)["one"].alias(f) for f in scalars], *[last(all_, f)["many"].alias(f) for f in lists])
    return let(F.transform(groups, values), pick)
