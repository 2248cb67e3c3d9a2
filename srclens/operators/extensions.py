"""Extensions R2-R5: operators described only in the planning documents.

R1 (co-change "shotgun surgery") is not built: counting file pairs changed
together enumerates every pair inside each commit, which this library does
not do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import go_trim
from .gotypes import KEY
from .pyfacts import FILE, cluster_files
from .pyscan import SIGNATURES, signatures


def _obsession(df: DataFrame, count_col: str) -> DataFrame:
    return df.select(
        "repo", F.lit(P.MOYEN).alias("severity"), F.lit(P.SMELL_PRIMITIVE_OBSESSION).alias("smell_type"),
        F.col("path").alias("file"), F.col("line").cast("int").alias("line"),
        F.col("component"), F.create_map(F.lit("primitive_fields"), F.col(count_col).cast("int")).alias("metrics"),
        F.lit(P.PATTERN_VALUE_OBJECT).alias("pattern"), F.lit(P.EFFORT_LOW).alias("effort"),
        *[F.lit(None).cast("string").alias(c) for c in ("explanation", "refactor_before", "refactor_after")])


def go_primitive_obsession(facts: dict[str, DataFrame]) -> DataFrame:
    """R2: structs with >= 3 field names holding a domain word, typed as a
    bare string/int/float64/bool."""
    f = (facts["fields"].filter(~F.col("embedded") & F.col("type").isin(*P.GO_PRIMITIVE_TYPES))
         .select(*KEY, "head_pos", F.explode("names").alias("n")))
    hit = F.lit(False)
    for w in P.GO_DOMAIN_WORDS:
        hit = hit | F.col("n").contains(w)
    counts = f.filter(hit).groupBy(*KEY, "head_pos").agg(F.count("*").alias("c"))
    s = facts["types"].filter(F.col("kind") == "struct").select(*KEY, "head_pos", F.col("name").alias("component"), "line")
    return _obsession(counts.filter(F.col("c") >= P.PRIMITIVE_MIN).join(s, [*KEY, "head_pos"]), "c")


#: String literals of one line, or a comment.
_PY_LITERAL = r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|#.*$"""


def _holds(name: str, chars: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(name).contains(ch) for ch in chars))


def py_signatures(files: DataFrame) -> DataFrame:
    """repo, path, line, signature: every ``def`` header as one logical line.

    A header goes on while its brackets are open, literals and comments not
    counted: from the def line on, the running bracket depth of the file's lines
    decides which physical lines belong to it. Literals are blank in the text.
    ``scanned_signatures`` gives the same rows without moving a line."""
    # Patterns run only on lines with a character that they need.
    code = F.when(_holds("raw", "'\"#"), F.regexp_replace("raw", _PY_LITERAL, " ")).otherwise(F.col("raw"))
    lines = (cluster_files(files.filter((F.col("lang") == "python") & F.col("content").isNotNull()))
             .select(*FILE, F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
             .select(*FILE, (F.col("pos") + 1).cast("int").alias("line"), code.alias("code")))
    opens, closes = (F.when(_holds("code", s), F.regexp_count("code", F.lit(r))).otherwise(F.lit(0)) for s, r in (("([{", r"[(\[{]"), (")]}", r"[)\]}]")))
    is_def = F.when(F.col("code").contains("def"), go_trim(F.col("code")).rlike(P.PY_FUNC)).otherwise(F.lit(False))
    wf = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    wg = Window.partitionBy(*FILE, "grp").orderBy("line")
    lines = (lines.withColumn("grp", F.sum(is_def.cast("int")).over(wf)).filter("grp > 0")
             .withColumn("depth", F.sum(opens - closes).over(wg.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("low", F.min("depth").over(wg.rowsBetween(Window.unboundedPreceding, -1))))
    return (lines.filter(F.coalesce(F.col("low") > 0, F.lit(True)))
            .groupBy(*FILE, "grp").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "code"))).alias("ls"))
            .select(*FILE, "line", F.array_join(F.transform("ls", lambda x: x["code"]), " ").alias("signature")))


def scanned_signatures(files: DataFrame) -> DataFrame:
    """The rows of ``py_signatures``, from files that are scanned whole."""
    files = cluster_files(files.filter((F.col("lang") == "python") & F.col("content").isNotNull()))
    return files.select(*FILE, "content").mapInArrow(signatures, SIGNATURES)


def parameters(signature: Column) -> Column:
    """The parameters of a logical def line: its text one bracket deep, cut at the commas; what lies in inner brackets is left out."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        text = (s["depth"] == 1) & ~opens & ~closes & ~s["done"]
        return F.struct(depth.alias("depth"), F.when(text, F.concat(s["out"], t)).otherwise(s["out"]).alias("out"),
                        (s["done"] | (closes & (depth == 0))).alias("done"))
    parts = F.regexp_extract_all(signature, F.lit(r"[()\[\]{}]|[^()\[\]{}]+"), F.lit(0))
    return F.split(F.aggregate(parts, start, step, lambda s: s["out"]), ",")


def py_primitive_obsession(files: DataFrame, defs: DataFrame) -> DataFrame:
    """``__init__`` methods of a class with >= 3 parameters ending in a
    domain suffix; signatures may span lines."""
    inits = defs.filter((F.col("name") == "__init__") & F.col("encl").isNotNull())
    names = F.transform(parameters(F.col("signature")), lambda p: F.regexp_extract(p, r"^\s*\**\s*(\w+)", 1))
    hits = F.size(F.filter(names, lambda n: F.exists(F.array(*[F.lit(s) for s in P.PY_DOMAIN_SUFFIXES]),
                                                     lambda s: n.endswith(s))))
    j = inits.join(scanned_signatures(files), [*FILE, "line"]).withColumn("c", hits)
    return _obsession(j.filter(F.col("c") >= P.PRIMITIVE_MIN)
                      .withColumn("component", F.concat_ws(".", "encl", "name")), "c")


def score_history(scans: DataFrame, k: int = P.HISTORY_SCANS, salt_buckets: int = 16) -> DataFrame:
    """The last ``k`` scans per repo with the change against the
    previous selected scan. Top-k is taken per (repo, salt) first, so a repo
    with a huge history is ranked by many tasks, then once more per repo on
    at most ``k * salt_buckets`` rows."""
    order = [F.col("ts").desc(), F.col("scan_id").desc()]
    salted = scans.withColumn("salt", F.pmod(F.xxhash64("scan_id"), F.lit(salt_buckets)))
    part = (salted.withColumn("r", F.row_number().over(Window.partitionBy("repo", "salt").orderBy(*order)))
            .filter(F.col("r") <= k).drop("r", "salt"))
    top = (part.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
           .filter(F.col("rank") <= k))
    wt = Window.partitionBy("repo").orderBy("ts", "scan_id")
    return top.withColumn("trend", F.col("score") - F.lag("score").over(wt))


def findings_by_file(findings: DataFrame, severities: list[str] | None = None,
                     smells: list[str] | None = None) -> DataFrame:
    """Filter by severity and smell, then one row per file with the count
    and the components in line order."""
    f = findings
    if severities:
        f = f.filter(F.col("severity").isin(*severities))
    if smells:
        f = f.filter(F.col("smell_type").isin(*smells))
    return (f.groupBy("repo", "file")
            .agg(F.count("*").alias("n"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "component"))),
                                          lambda x: x["component"]), ",").alias("components")))
