"""String expressions used by the operators. All are built-in Spark
functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def go_trim(col: Column) -> Column:
    """strings.TrimSpace: strip Unicode white space at both ends."""
    return F.trim(col, F.lit(P.GO_SPACE_CHARS))


def indent_width(raw: Column) -> Column:
    """Leading indent: a space counts 1, a tab counts 4, stop at anything else."""
    lead = F.regexp_extract(raw, r"^[ \t]*", 0)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return (F.length(lead) + F.lit(3) * tabs).cast("int")


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("int")


def py_keyword_count(stripped: Column) -> Column:
    # Most lines hold none of the letters: the pattern runs on the others ("elif" holds "if", "for" holds "or").
    some = F.lit(False)
    for part in P.PY_CC_PARTS:
        some = some | stripped.contains(part)
    return F.when(some, count_matches(stripped, P.PY_CC)).when(stripped.isNotNull(), F.lit(0))


def html_escape(col: Column) -> Column:
    """Escape text for an HTML cell the way Go's html/template does for text."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for src, dst in (("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
                     ("+", "&#43;"), ("\u0000", "\ufffd")):
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """filepath.Dir on slash paths: everything before the last slash, or '.'."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(path, "/") == 0, F.lit(".")).when(d == "", F.lit("/")).otherwise(d)


def metrics_text(metrics: Column) -> Column:
    """Sorted ``k=v`` pairs joined by ``, `` (empty string for an empty or null map)."""
    entries = F.array_sort(F.map_entries(F.coalesce(metrics, F.create_map().cast("map<string,int>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def json_string(text: Column) -> Column:
    """A JSON string the way Go's encoder writes it: also <, > and & and the line separators are escaped."""
    out = F.to_json(F.array(text))
    out = F.substring(out, 2, F.length(out) - 2)
    for ch, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        out = F.replace(out, F.lit(ch), F.lit("\\u" + code))
    return out


def json_indented(value: Column, kind: T.DataType, level: int = 0) -> Column:
    """JSON text with two spaces per level, one field or element a line; null
    fields are left out. The nesting is that of the type, so every indent is a
    constant and the text is put together in one pass."""
    pad, inner = "\n" + "  " * level, "\n" + "  " * (level + 1)

    def listed(open_: str, empty: Column, items: Column, close: str) -> Column:
        return F.when(empty, F.lit(open_ + close)).otherwise(
            F.concat(F.lit(open_ + inner), F.array_join(items, "," + inner), F.lit(pad + close)))
    if isinstance(kind, T.StructType):
        fields = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f'"{f.name}": '), json_indented(value[f.name], f.dataType, level + 1)))
                  for f in kind.fields]
        empty = F.coalesce(*[F.when(value[f.name].isNotNull(), F.lit(False)) for f in kind.fields], F.lit(True))
        return listed("{", empty, F.array_compact(F.array(*fields)), "}")
    if isinstance(kind, T.ArrayType):
        return listed("[", F.size(value) == 0, F.transform(value, lambda x: json_indented(x, kind.elementType, level + 1)), "]")
    return json_string(value) if isinstance(kind, T.StringType) else value.cast("string")
