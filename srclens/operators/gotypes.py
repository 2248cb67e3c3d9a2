"""Go types: type text, and resolution of names (types and fields come from ``goscan``).

G13    ``type_text``: one fold over the tokens of a type.
G9     ``struct_names``: import paths are matched to package directories by
       their longest suffix, and chains of defined types (``type X Y``) are
       followed by pointer jumping, so a chain of n definitions takes log2(n)
       joins of the (small) table of type specs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .stage import stage

#: A file: the hash keeps shuffles and sorts cheap, the names keep it exact.
KEY = ["fid", "repo", "path"]
IDENT = "^" + P.GO_ID + "$"


def is_ident(tok: Column) -> Column:
    return F.coalesce(tok.rlike(IDENT), F.lit(False))


def line_tokens(lines: DataFrame, *keep: str) -> DataFrame:
    """Token rows of masked lines (literals and comments are blank), each line
    closed by a newline token; ``pos`` = (line, i) orders the tokens of a file."""
    toks = F.regexp_extract_all(F.col("m"), F.lit(P.GO_TOKEN_ANALYSIS), F.lit(0))
    toks = F.concat(F.filter(toks, lambda t: t.rlike(P.GO_KEEP)), F.array(F.lit("\n")))
    return lines.select(*KEY, "dir", "line", *keep, F.posexplode(toks).alias("i", "tok")).withColumn("pos", F.struct("line", "i"))


def bracket_delta(tok: Column) -> Column:
    return F.when(tok.isin("{", "(", "["), 1).when(tok.isin("}", ")", "]"), -1).otherwise(0)


def type_text(toks: Column) -> Column:
    """The text of a type expression from its tokens, by one fold.

    Array lengths are dropped; function types read ``func(...)``, interface
    types ``interface{}``; struct literals, generic instances and types in
    parentheses read ``?``; channels of any direction read ``chan T``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("hide"), F.lit(False).alias("done"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        hidden, done = s["hide"] > 0, s["done"]
        name = is_ident(s["last"]) & ~s["last"].isin(*P.GO_TYPE_WORDS)
        instance = (t == "[") & name
        key = (t == "[") & (s["last"] == "map")
        out = (F.when(hidden | (t == "\n"), s["out"])
               .when(t == "]", F.concat(s["out"], t))  # the end of a map's key
               .when(done, s["out"])
               .when(t == "func", F.concat(s["out"], F.lit("func(...)")))
               .when(t == "interface", F.concat(s["out"], F.lit("interface{}")))
               .when(t == "struct", F.concat(s["out"], F.lit("?")))
               .when(t == "chan", F.concat(s["out"], F.lit("chan ")))
               .when(instance, F.regexp_replace(s["out"], r"(?:" + P.GO_ID + r"\.)?" + P.GO_ID + "$", "?"))
               .when(key, F.concat(s["out"], t))
               .when(t == "[", F.concat(s["out"], F.lit("[]")))
               .when(t == "(", F.concat(s["out"], F.lit("?")))
               .when(t == "{", s["out"]).otherwise(F.concat(s["out"], t)))
        hide = (F.when(hidden, s["hide"] + opens.cast("int") - closes.cast("int"))
                .when(opens & ~key, F.lit(1)).otherwise(F.lit(0)))
        now = F.when(hidden, done).when(t == "]", F.lit(False)).when(t == "func", F.lit(True)).otherwise(done)
        return F.struct(out.alias("out"), hide.alias("hide"), now.alias("done"), t.alias("last"))
    return F.aggregate(toks, start, step, lambda s: s["out"])


# ---------------------------------------------------------------- names
def import_targets(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, path, qual, target): the package directory that a file's qualifier
    stands for; a dot import has qual ''.

    imports: repo, path, alias, import_path; packages: repo, pkg (directory),
    package (its clause). The directory below the repo is a suffix of the import
    path (its module's path comes before); the longest such one is taken."""
    rel = F.when(F.startswith("pkg", F.concat("repo", F.lit("/"))), F.expr("substring(pkg, length(repo) + 2)")).otherwise(F.col("pkg"))
    dirs = packages.groupBy("repo", "pkg").agg(F.min("package").alias("package")).withColumn("suffix", rel).withColumnRenamed("pkg", "target")
    parts = F.split("import_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    each = (imports.filter(F.coalesce(F.col("alias"), F.lit("")) != "_")
            .select("repo", "path", "alias", "import_path", F.explode(suffixes).alias("suffix")))
    best = (each.join(dirs, ["repo", "suffix"]).groupBy("repo", "path", "alias", "import_path")
            .agg(F.max_by(F.struct("target", "package"), F.length("suffix")).alias("t")))
    qual = F.when(F.col("alias") == ".", F.lit("")).otherwise(F.coalesce("alias", "t.package"))
    return best.select("repo", "path", qual.alias("qual"), F.col("t.target").alias("target")).distinct()


def bind(names: DataFrame, types: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``found`` (a struct of package and name) of the declared type that
    (qual, base) stands for in a file: a name of its own package, of a dot
    import, or of the package behind the qualifier; null where none is in the
    corpus. names: n (unique), repo, path, pkg, qual, base."""
    own = names.filter("qual = ''").select("n", "repo", F.col("pkg").alias("target"), "base", F.lit(0).alias("prio"))
    other = names.join(targets, ["repo", "path", "qual"]).select("n", "repo", "target", "base", F.lit(1).alias("prio"))
    known = types.select("repo", F.col("pkg").alias("target"), F.col("name").alias("base")).distinct()
    hit = (own.unionByName(other).join(known, ["repo", "target", "base"]).groupBy("n")
           .agg(F.min(F.struct("prio", "target", "base")).alias("best")))
    return names.join(hit, "n", "left").withColumn("found", F.when(F.col("best").isNotNull(), F.struct(
        F.col("best.target").alias("pkg"), F.col("best.base").alias("name")))).drop("best")


def struct_names(types: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, pkg, name, is_struct, alias of every top-level type name: is its
    underlying type a struct? (G9)

    ``type X Y`` points to Y. A round replaces the pointer of every name by the
    pointer of the name it points to, so chains halve; a chain that is still
    open after log2 of their number of rounds is a cycle and no struct."""
    top = types.filter("top").groupBy("repo", "pkg", "name").agg(
        F.max_by(F.struct("path", "kind", "alias", "to_qual", "to_name"), F.struct("path", "line")).alias("t"))
    top = stage(top.select("repo", "pkg", "name", "t.*"), "typenames")
    links = top.filter((F.col("kind") == "other") & F.col("to_name").isNotNull() & ~((F.col("to_qual") == "") & F.col("to_name").isin(*P.GO_PREDECLARED)))
    links = links.select(F.struct("repo", "pkg", "name").alias("n"), "repo", "path", "pkg", F.col("to_qual").alias("qual"), F.col("to_name").alias("base"))
    now = bind(links, top, targets).filter("found is not null").select(
        F.col("n").alias("at"), F.struct("repo", F.col("found.pkg").alias("pkg"), F.col("found.name").alias("name")).alias("to"))
    now = stage(now, "typechains")
    rounds = max(0, math.ceil(math.log2(now.count() + 1)))
    for _ in range(rounds):
        nxt = now.select(F.col("at").alias("to"), F.col("to").alias("further"))
        jumped = now.join(nxt, "to", "left")
        if jumped.filter("further is not null").isEmpty():
            break
        now = stage(jumped.select("at", F.coalesce("further", "to").alias("to")), "typechains")
    kind = top.select(F.struct("repo", "pkg", "name").alias("to"), F.col("kind").alias("end_kind"))
    ends = now.join(kind, "to").select(F.col("at.repo").alias("repo"), F.col("at.pkg").alias("pkg"), F.col("at.name").alias("name"), "end_kind")
    return (top.join(ends, ["repo", "pkg", "name"], "left")
            .select("repo", "pkg", "name", "alias", (F.coalesce("end_kind", "kind") == "struct").alias("is_struct")))


def concrete_fields(types: DataFrame, fields: DataFrame, targets: DataFrame) -> DataFrame:
    """G9/G10 + J6: named fields with an injectable name whose type is concrete.

    A type name (one leading ``*`` and type arguments removed) declared in the
    corpus is concrete if its underlying type is a struct and the name is no
    alias. Predeclared names and type parameters are not concrete. Names that
    are not in the corpus follow the syntactic rule: pointer to an unqualified
    name without type arguments."""
    inj = F.exists("names", lambda n: F.lower(n).isin(*P.INJECTABLE_NAMES))
    cand = (fields.filter(~F.col("embedded") & inj & (F.col("base") != "") & ~F.array_contains("type_params", F.col("base")))
            .select(F.struct(*KEY, "head_pos", "line", F.element_at("names", 1).alias("first_name")).alias("n"), "repo", "path", "pkg",
                    "struct", "line", F.element_at("names", 1).alias("first_name"), "type", "ptr", "qual", "base", "instance"))
    cand = cand.filter(~((F.col("qual") == "") & F.col("base").isin(*P.GO_PREDECLARED)))
    known = struct_names(types, targets)
    found = bind(cand, known, targets)
    ends = known.select("repo", F.struct("pkg", "name").alias("found"), "is_struct", "alias")
    j = found.join(ends, ["repo", "found"], "left")
    syntactic = F.col("ptr") & (F.col("qual") == "") & ~F.col("instance")
    return (j.filter(F.coalesce(F.col("is_struct") & ~F.col("alias"), syntactic))
            .select("repo", "pkg", "path", "struct", "line", "first_name", "type"))
