"""Go structural facts.

``if``, ``for``, ``case`` are reserved words and ``&&``/``||`` have no other
use, so once comments and string/rune/raw literals are out of the way,
counts of those tokens equal the syntax-tree counts of the analysed tool.

The facts come from ``goscan``, which reads every file once in the task that
has it; ``Facts`` names the tables and stages the scan when one is asked for.

G8   methods per receiver are counted per package and joined to structs.
G9/G10  see ``gotypes``.

``facts["lines"]``, for callers that want lines, is the relational form of the
same rules (``go_masked_lines``: comments and literals are blanked by array
functions, one ordered window over (file, line) gives depths, declaration ids
and the lines of signatures and type declarations; ``line_facts`` keeps the rows
with a fact). ``go_params`` and ``go_calls`` read such lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import dir_name
from .goscan import FOUND, scanner
from .gotypes import KEY, bracket_delta, concrete_fields, import_targets, is_ident, line_tokens, type_text
from .pyfacts import FILE, file_partitions
from .stage import Facts, stage

_DECL_KW = ["func", "type", "var", "const", "import", "package"]
#: The first letters are looked at first, and the look-behind comes after the word, so that most places end at once.
_CC_WORD = r"(?=[ifc])(?:if|for|case)(?<![\p{L}\p{Nd}_](?:if|for|case))" + P.GO_NOT_ID_AFTER
_CALL = r"(?<![\p{L}\p{Nd}_.])(" + P.GO_ID + r")\.(" + P.GO_ID + r")[ \t]*\("
_TYPE_LINE = r"(?:^|[{;])[ \t]*type" + P.GO_NOT_ID_AFTER
#: Columns of the staged line table.
LINE_FACTS = [*KEY, "dir", "line", "m", "raw", "cc", "first", "has_open", "has_close", "depth_after", "decl_start",
              "decl_id", "kw", "sig", "region", "top", "calls"]


def go_files(files: DataFrame) -> DataFrame:
    """The Go files that are analysed: those of a package load, without ``_test.go``."""
    files = files.filter((F.col("lang") == "go") & F.col("content").isNotNull()
                         & ~F.col("path").endswith("_test.go"))
    return files if "dir" in files.columns else files.withColumn("dir", dir_name(F.col("path")))


def key_order(files: DataFrame) -> DataFrame:
    """The files with their ``fid``, dealt and sorted by their key; those of one key in the order in which they come."""
    files = files.withColumn("fid", F.xxhash64(*FILE))
    return files.repartition(file_partitions(files), "fid").sortWithinPartitions(*KEY)


def go_masked_lines(files: DataFrame) -> DataFrame:
    """G1 at line granularity: one row per source line with the raw and the
    masked text, brace/paren deltas, cc-token count, depth at line start, the
    declaration id and the flags ``sig`` (line of a function's signature),
    ``region`` (line of a type declaration) and ``top`` (that one is at top
    level).

    Masking is a per-file array transform of the token array (no rows per
    token); the only windows run over lines, in one order per file.
    """
    # Files in order, so that their lines need little sorting; the raw text goes along where it is another.
    files = files.withColumn("fid", F.xxhash64(*FILE)).repartition(file_partitions(files), "fid").sortWithinPartitions("fid")
    df = files.select(*KEY, "dir",
                      F.posexplode(F.arrays_zip(F.split(F.col("content"), "\n", -1).alias("raw"),
                                                F.split(masked(F.col("content")), "\n", -1).alias("m"))).alias("pos", "z"))
    df = df.select(*KEY, "dir", (F.col("pos") + 1).cast("int").alias("line"),
                   F.col("z.raw").alias("raw"), F.coalesce(F.col("z.m"), F.lit("")).alias("m"))
    df = df.withColumn("raw", F.when(F.col("raw") != F.col("m"), F.col("raw")))
    return line_states(line_marks(df)).withColumn("raw", F.coalesce("raw", "m"))


def masked(content: F.Column) -> F.Column:
    """The text with every comment and literal blanked."""
    toks = F.regexp_extract_all(content, F.lit(P.GO_CHUNK), F.lit(0))

    def mask(t):
        # Length-preserving: every character of a comment or literal except
        # newlines becomes a space, so positions in the masked line are
        # positions in the raw line (used by the skeleton).
        lit = (t.startswith('"') | t.startswith("'") | t.startswith("`")) & (F.length(t) > 1)
        com = t.startswith("//") | (t.startswith("/*") & (F.length(t) > 3))
        return F.when(lit | com, F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    any_mark = F.lit(False)
    for mark in ('"', "'", "`", "//", "/*"):
        any_mark = any_mark | content.contains(mark)
    return F.when(any_mark, F.array_join(F.transform(toks, mask), "")).otherwise(content)


def _count(part: str) -> F.Column:
    # Bytes, as characters would have to be counted; part is ASCII.
    n = F.octet_length("m") - F.octet_length(F.replace(F.col("m"), F.lit(part), F.lit("")))
    return n if len(part) == 1 else (n / len(part)).cast("int")


def _contains(*words: str) -> F.Column:
    some = F.lit(False)
    for word in words:
        some = some | F.col("m").contains(word)
    return some


def line_marks(df: DataFrame) -> DataFrame:
    """Bracket deltas, cc tokens, braces and the first word (if it can be a declaration's) of each row's masked text."""
    words = F.when(_contains("if", "for", "case"), F.regexp_count(F.col("m"), F.lit(_CC_WORD))).otherwise(0)
    lead = F.ltrim(F.col("m"), F.lit(" \t"))
    starts = F.lit(False)
    for word in _DECL_KW:
        starts = starts | lead.startswith(word)
    return (df.withColumn("bd", (_count("{") - _count("}")).cast("int"))
            .withColumn("dl", (F.col("bd") + _count("(") - _count(")") + _count("[") - _count("]")).cast("int"))
            .withColumn("cc", (_count("&&") + _count("||") + words).cast("int"))
            .withColumn("has_open", F.col("m").contains("{"))
            .withColumn("has_close", F.col("m").contains("}"))
            .withColumn("first", F.when(starts, F.regexp_extract("m", r"^[ \t]*(" + P.GO_ID + ")", 1)).otherwise("")))


def line_states(df: DataFrame) -> DataFrame:
    """Depths, declarations and type statements of the rows of ``line_marks``, by one ordered window per file."""
    w = Window.partitionBy(*KEY).orderBy("line")
    wb, wr = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    # Three passes: what depends on nothing, on depths, and on type statements.
    df = df.select("*", F.sum("dl").over(wr).cast("int").alias("depth_after"), F.sum("bd").over(wr).cast("int").alias("bdepth_after"),
                   F.row_number().over(w).alias("nth"))
    df = df.select("*", (F.col("depth_after") - F.col("dl")).alias("depth_before"),
                   (F.col("bdepth_after") - F.col("bd")).alias("bdepth_before")).drop("bdepth_after")
    start = (F.col("depth_before") == 0) & F.col("first").isin(*_DECL_KW)
    # A body opens where nothing but braces is open (not inside a parameter list).
    body_open = F.col("has_open") & (F.col("bdepth_before") == 0) & (F.col("depth_after") == F.col("bd"))
    # Type statements inside functions, with their bodies.
    inner = (F.col("first") != "type") | (F.col("depth_before") > 0)
    inner = inner & F.col("m").contains("type") & F.col("m").rlike(_TYPE_LINE)

    def latest(when: F.Column, what: F.Column, over) -> F.Column:
        return F.last(F.when(when, what), ignorenulls=True).over(over)
    head = F.struct(F.col("first").alias("k"), F.col("line").alias("l"), F.col("nth").alias("o"))
    df = df.select("*", start.alias("decl_start"), F.sum(start.cast("int")).over(wr).alias("decl_id"),
                   # Declaration keyword, first line and place, carried to every line.
                   latest(start, head, wr).alias("kw"),
                   latest(inner, F.struct(F.col("line").alias("l"), F.col("depth_before").alias("d")), wr).alias("ts"),
                   latest(body_open, F.col("nth"), wb).alias("body"))
    # A signature runs from the func line to the line that opens the body.
    sig = (F.col("kw.k") == "func") & (F.coalesce(F.col("body"), F.lit(0)) < F.col("kw.o"))
    df = df.withColumn("tclose", latest((F.col("line") >= F.col("ts.l")) & (F.col("depth_after") <= F.col("ts.d")), F.col("line"), wb))
    top = F.coalesce((F.col("kw.k") == "type") & (F.col("decl_id") > 0), F.lit(False))
    local = F.col("ts").isNotNull() & (F.coalesce(F.col("tclose"), F.lit(-1)) < F.col("ts.l"))
    return (df.withColumn("sig", F.coalesce(sig, F.lit(False))).withColumn("region", top | local).withColumn("top", top)
            .drop("ts", "tclose", "body", "nth"))


def line_facts(lines: DataFrame) -> DataFrame:
    """The rows and columns that are staged: masked text of signatures, type
    declarations and package clauses, raw text of imports, call targets. Of
    the other lines, a file's first and those of functions with braces or cc tokens."""
    is_func = F.col("kw.k") == "func"
    keep = F.col("sig") | F.col("region") | (F.col("kw.k") == "package")
    calls = F.when(is_func & F.col("m").contains("."), F.regexp_extract_all("m", F.lit(_CALL), F.lit(0)))
    kept = lines.select(*KEY, "dir", "line", F.when(keep, F.col("m")).alias("m"),
                        F.when(F.col("kw.k") == "import", F.col("raw")).alias("raw"), "cc",
                        F.when(F.col("decl_start"), F.col("first")).alias("first"), "has_open", "has_close",
                        "depth_after", "decl_start", "decl_id", "kw", "sig", "region", "top",
                        F.when(F.size(calls) > 0, calls).alias("calls")).select(*LINE_FACTS)
    braces = F.col("has_open") | F.col("has_close") | (F.col("cc") > 0)
    used = ((F.col("line") == 1) | F.col("m").isNotNull() | F.col("raw").isNotNull() | F.col("calls").isNotNull()
            | F.col("decl_start") | ((F.col("kw.k") == "func") & braces))
    return kept.filter(F.coalesce(used, F.lit(False)))


def go_structs(types: DataFrame, fields: DataFrame, funcs: DataFrame) -> DataFrame:
    """G6-G8 + J1: struct rows with field and method counts.

    A (pkg, name) declared twice keeps the last one (latest file, then line),
    with that declaration's fields. Methods are counted per (pkg, receiver)
    across all files of the package.
    """
    nf = fields.groupBy(*KEY, "head_pos").agg(F.sum(F.when(F.col("embedded"), 1).otherwise(F.size("names"))).alias("nf"))
    st = (types.filter(F.col("kind") == "struct").join(nf, [*KEY, "head_pos"], "left")
          .groupBy("repo", "pkg", "name")
          .agg(F.max_by(F.struct("path", "line", "nf"), F.struct("path", "head_pos")).alias("s")))
    methods = (funcs.filter(F.coalesce(F.col("recv"), F.lit("")) != "")
               .groupBy("repo", "pkg", F.col("recv").alias("name")).agg(F.count("*").alias("methods")))
    return (st.join(methods, ["repo", "pkg", "name"], "left")
            .select("repo", "pkg", F.col("s.path").alias("path"), "name",
                    F.col("s.line").cast("int").alias("line"),
                    F.coalesce(F.col("s.nf"), F.lit(0)).cast("int").alias("fields"),
                    F.coalesce("methods", F.lit(0)).cast("int").alias("methods")))


def go_params(lines: DataFrame) -> DataFrame:
    """Parameters of each function declaration in order: name (null where
    the list has types only) and type text (G13).

    The signature's lines move, not their tokens; these are ordered once per declaration. The
    parameter list is the first ``(`` at depth 0 after the function's name; a
    comma one level inside starts the next parameter. ``a, b int``: a lone name
    takes the type of the next parameter that has one."""
    sigs = (lines.filter("sig").select(*KEY, "dir", "line", "m", F.col("kw.l").alias("at"))
            .repartition(file_partitions(lines), "fid").sortWithinPartitions("fid", "line"))
    t = line_tokens(sigs, "at").filter(F.col("tok") != "\n").drop("dir")
    decl = [*KEY, "at"]
    w = Window.partitionBy(*decl).orderBy("line", "i").rowsBetween(Window.unboundedPreceding, 0)
    t = (t.withColumn("d", F.sum(bracket_delta(F.col("tok"))).over(w)).withColumn("d0", F.col("d") - bracket_delta(F.col("tok")))
         .withColumn("name", F.first(F.when((F.col("d0") == 0) & is_ident(F.col("tok")) & (F.col("tok") != "func"), F.col("tok")),
                                     ignorenulls=True).over(w))
         .select("*", F.sum(F.when((F.col("tok") == "(") & (F.col("d0") == 0) & F.col("name").isNotNull(), 1)
                            .otherwise(0)).over(w).alias("opened"),
                 F.sum(F.when((F.col("tok") == ")") & (F.col("d") == 0) & F.col("name").isNotNull(), 1)
                       .otherwise(0)).over(w).alias("closed")))
    p = (t.filter((F.col("opened") == 1) & (F.col("closed") == 0) & (F.col("d0") >= 1))
         .withColumn("comma", (F.col("tok") == ",") & (F.col("d0") == 1))
         .withColumn("idx", F.sum(F.col("comma").cast("int")).over(w)).filter("not comma"))
    p = (p.groupBy(*decl, F.col("name").alias("func"), "idx")
         .agg(F.sort_array(F.collect_list(F.struct("line", "i", "tok", "d"))).alias("ts"))
         .withColumn("toks", F.transform("ts", lambda x: x["tok"])))
    toks, n = F.col("toks"), F.size("toks")
    first, second, third = (F.try_element_at(toks, F.lit(k)) for k in (1, 2, 3))
    # In ``a [n]T`` the bracket closes before the end, in the instance ``T[K]`` at the end.
    closes = F.array_position(F.transform("ts", lambda x: (x["tok"] == "]") & (x["d"] == 1)), F.lit(True))
    named = is_ident(first) & ~first.isin(*P.GO_TYPE_WORDS) & (
        is_ident(second) | second.isin("*", "(") | ((second == "[") & (closes < n)) | ((second == ".") & (third == ".")))
    p = p.withColumn("named", F.coalesce(named, F.lit(False)))
    wd = Window.partitionBy(*decl)
    after = wd.orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("named"), type_text(F.slice(toks, 2, F.greatest(n - 1, F.lit(0)))))
    p = (p.withColumn("any_named", F.max("named").over(wd)).withColumn("own", own)
         .withColumn("next", F.first("own", ignorenulls=True).over(after)))
    return p.select("repo", "path", "func", F.col("at").cast("int").alias("line"), F.col("idx").cast("int").alias("idx"),
                    F.when(F.col("any_named"), first).alias("name"),
                    F.when(F.col("any_named"), F.col("next")).otherwise(type_text(toks)).alias("type"))


#: Calls of a function that are listed (O3).
CALLS = 10


def go_calls(lines: DataFrame, limit: int = CALLS) -> DataFrame:
    """G14 + O3/O5: call targets ``x.Sel(`` with a plain identifier on the
    left, distinct per function, the first ``limit`` in source order."""
    c = (lines.filter((F.col("kw.k") == "func") & F.col("calls").isNotNull())
         .select(*KEY, F.col("kw.l").alias("fline"), "line", F.posexplode("calls").alias("k", "c"))
         .withColumn("call", F.regexp_replace("c", r"[ \t]*\($", "")))
    first = c.groupBy(*KEY, "fline", "call").agg(F.min(F.struct("line", "k")).alias("at"))
    w = Window.partitionBy(*KEY, "fline").orderBy("at")
    return (first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .select("repo", "path", F.col("fline").cast("int").alias("func_line"), "call",
                    F.col("rank").cast("int").alias("rank")))


def go_facts(files: DataFrame, materialize: bool = True) -> Facts:
    """All Go facts of a source table (``_test.go`` files excluded): packages, imports, funcs, types, fields, structs,
    concrete_fields, params, calls, and lines on demand.

    Every task scans its files whole (``goscan``); what leaves it, and is staged, is one row per function, package
    clause, import, type and field. Parameters and calls come from a scan in ``detail``; who reads them asks for that
    first, so that the other facts come from the same scan."""
    def kept(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name) if materialize else df

    def scanned(detail: bool) -> DataFrame:
        return kept(key_order(go_files(files)).select(*KEY, "dir", "content").mapInArrow(scanner(detail), FOUND), "gofacts")

    def of(what: str, *columns: str | Column, found: str = "found") -> Callable[[Facts], DataFrame]:
        return lambda f: f[found].filter(F.col("what") == what).select(*columns)
    return Facts({
        "lines": lambda f: kept(line_facts(go_masked_lines(go_files(files))), "golines"),
        "detail": lambda f: scanned(True),
        "found": lambda f: f["detail"] if "detail" in f else scanned(False),
        "packages": of("package", *FILE, "pkg", F.col("name").alias("package")),
        "imports": of("import", *FILE, "line", "nth", F.col("import_alias").alias("alias"), "import_path"),
        "funcs": of("func", "repo", "pkg", "path", "name", "recv", "recv_cc", "line", "lines", "complexity"),
        "types": of("type", *KEY, "pkg", "name", "kind", "line", "head_pos", "top", "alias", "type_params", "to_qual", "to_name"),
        "fields": of("field", *KEY, "pkg", "head_pos", F.col("nth").alias("field_no"), F.col("name").alias("struct"), "type_params", "line", "names",
                     "embedded", "type", "ptr", "qual", "base", "instance"),
        "params": of("param", "repo", "path", "func", "line", F.col("nth").alias("idx"), "name", "type", found="detail"),
        "calls": lambda f: f["detail"].filter((F.col("what") == "call") & (F.col("nth") <= CALLS)).select(
            "repo", "path", F.col("line").alias("func_line"), F.col("name").alias("call"), F.col("nth").alias("rank")),
        "structs": lambda f: go_structs(f["types"], f["fields"], f["funcs"]),
        "concrete_fields": lambda f: concrete_fields(f["types"], f["fields"], import_targets(f["imports"], f["packages"])),
    })
