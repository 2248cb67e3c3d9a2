"""Python structural facts as Spark operators.

The line scanner of the analysed tool (a stack machine over the lines of one
file) is re-expressed as running values over arrays of lines (``pyscan``):

* P1-P5  skip flag, indent width, header and method tests per line
  (``py_lines`` gives them as rows).
* P10    a running count of ``def`` headers gives each line its latest def;
  the line is in that def's body while the running minimum indent since the
  def stays above the def's indent.
* P11    complexity is a grouped sum of keyword counts over body lines.
* P6/P7  scope ends and the innermost open class use *indent thresholds*: a
  line of indent ``i`` can close a scope of indent ``t`` only if ``i <= t``,
  so for every header indent the ordered positions of those lines are
  searched for the one before or behind a header.
* P8/P12 methods and ``self.x =`` lines go to the latest class header of
  that name above them.

The source table is hash-partitioned by the file key ``(repo, path)`` once;
a file's lines never leave the task that has the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import go_trim, indent_width, py_keyword_count
from .pyscan import FOUND, scan
from .stage import Facts, stage

FILE = ["repo", "path"]
_BIG = 1 << 30


#: Bytes of input that one task of the file shuffle should get at most: few, as columns of numbers on disk
#: may stand for thirty times their size in lines, and a task sorts its lines in memory.
TASK_BYTES = 1 << 20


def file_partitions(files: DataFrame, per_core: int = 4) -> int:
    """Partition count for the file shuffle; it grows with the input.

    The raw content is small on disk but explodes into lines or tokens, so
    adaptive coalescing (which looks at shuffle bytes) would squeeze it into
    a handful of tasks. An explicit count is never coalesced. It is the
    largest of the shuffle partitions, ``per_core`` tasks per core, and one task per
    TASK_BYTES of the scanned tables' size (the optimizer's figure; leaves
    without one do not count). Override with ``srclens.files.partitions``.
    """
    spark = files.sparkSession
    conf = spark.conf.get("srclens.files.partitions", None)
    if conf:
        return int(conf)
    leaves = files._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    scanned = sum(x for x in sizes if x < 1 << 60)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, per_core * spark.sparkContext.defaultParallelism, -(-scanned // TASK_BYTES))


def cluster_files(files: DataFrame) -> DataFrame:
    """Hash-partition a source table by file so that all per-file windows
    and aggregations downstream reuse one shuffle of the raw content. The
    files lie in order, so that the windows find their lines nearly sorted."""
    return files.repartition(file_partitions(files), *FILE).sortWithinPartitions(*FILE)


def py_lines(files: DataFrame, keep_skipped: bool | str = False) -> DataFrame:
    """One row per line with header classification.

    Columns: repo, path, line, raw, text (trimmed), indent, skip, cls_name,
    def_name, is_class, is_def, is_method, kw (keyword count).
    """
    df = files.select(*FILE, F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "raw"))
    text = go_trim(F.col("raw"))
    df = (df.select(*FILE, (F.col("pos") + 1).cast("int").alias("line"), "raw", text.alias("text"))
          .withColumn("skip", (F.col("text") == "") | F.col("text").startswith("#")))
    if not keep_skipped:
        df = df.filter(~F.col("skip"))
    elif keep_skipped == "first":  # so that a file without code still has a row
        df = df.filter(~F.col("skip") | (F.col("line") == 1))
    # Regexes run only on lines whose prefix can match (cheap guard).
    cls_name = F.regexp_extract("text", P.PY_CLASS, 1)
    def_name = F.regexp_extract("text", P.PY_FUNC, 1)
    df = (df.withColumn("indent", indent_width(F.col("raw")))
          .withColumn("cls_name", F.when(~F.col("skip") & F.col("text").startswith("class"), cls_name)
                      .otherwise(F.lit("")))
          .withColumn("is_class", F.col("cls_name") != "")
          .withColumn("def_name", F.when(~F.col("skip") & ~F.col("is_class")
                                         & F.col("text").startswith("def"), def_name)
                      .otherwise(F.lit("")))
          .withColumn("is_def", F.col("def_name") != "")
          .withColumn("is_method", F.when(F.col("is_def"), F.col("text").rlike(P.PY_METHOD))
                      .otherwise(F.lit(False)))
          .withColumn("kw", py_keyword_count(F.col("text"))))
    return df


def with_def_groups(lines: DataFrame) -> DataFrame:
    """P10: add ``in_body`` (the line counts for the def ``grp``, the ordinal of
    the latest def above, 0 = none), ``def_indent`` and ``complexity``."""
    wg = Window.partitionBy(*FILE, "grp").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    run_min = F.min(F.when(F.col("is_def"), F.lit(_BIG)).otherwise(F.col("indent"))).over(wg)
    return (lines.select("*", F.first("indent").over(wg).alias("def_indent"), run_min.alias("run_min"))
            .withColumn("in_body", (F.col("grp") > 0) & ~F.col("is_def")
                        & (F.col("run_min") > F.col("def_indent")))
            .drop("run_min")
            # P11 in the same (file, def group) partition: the sort is shared.
            .withColumn("complexity", (F.lit(1) + F.sum(
                F.when(F.col("in_body") & ~F.col("is_class"), F.col("kw")).otherwise(F.lit(0)))
                .over(wg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).cast("int")))


def code_lines(files: DataFrame, materialize: bool = True) -> DataFrame:
    """Lines of code with what P1-P5 and P10 say of them, for callers that want lines: one row each, no text.

    The facts below do not read them."""
    lines = (py_lines(cluster_files(files), keep_skipped="first")
             .withColumn("self_field", F.col("raw").contains("self.") & F.col("raw").rlike(P.PY_SELF_FIELD))
             .select(*FILE, "line", "skip", "indent", "cls_name", "is_class", "def_name", "is_def",
                     "is_method", "kw", "self_field"))
    # Header indents per file (P6/P7 thresholds), in the pass that counts defs.
    upto = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = lines.select("*", F.sum(F.col("is_def").cast("int")).over(upto).alias("grp"),
                         F.collect_set(F.when(F.col("is_class"), F.col("indent"))).over(whole).alias("cls_thr"),
                         F.collect_set(F.when(F.col("is_class") | F.col("is_def"), F.col("indent"))).over(whole).alias("hdr_thr"))
    # A line deeper than every threshold closes nothing: it needs no list (a def still looks for its class).
    lines = (lines.withColumn("cls_thr", F.when(F.col("is_def") | (F.col("indent") <= F.array_max("cls_thr")), F.col("cls_thr")))
             .withColumn("hdr_thr", F.when(F.col("indent") <= F.array_max("hdr_thr"), F.col("hdr_thr"))))
    lines = with_def_groups(lines)
    if materialize:
        lines = stage(lines, "pylines")
    return lines.filter("not skip")


def py_facts(files: DataFrame, materialize: bool = True) -> Facts:
    """All Python facts of a source table: files, defs, funcs, classes, scopes, and lines on demand.

    Every task scans its files whole (``pyscan.scan``); what leaves it, and is staged, is one row
    per file (``files``: S7, P16), class and def."""
    files = files.filter((F.col("lang") == "python") & F.col("content").isNotNull())

    def found(facts: Facts) -> DataFrame:
        rows = cluster_files(files).select(*FILE, "content").mapInArrow(scan, FOUND)
        return stage(rows, "pyfacts") if materialize else rows

    def of(what: str, *columns: str | Column) -> Callable[[Facts], DataFrame]:
        return lambda facts: facts["found"].filter(F.col("what") == what).select(*FILE, *columns)
    kind = F.when(F.col("what") == "def", "func").otherwise(F.col("what")).alias("kind")
    return Facts({
        "found": found,
        "files": of("file"),
        "defs": of("def", "line", "name", "indent", "is_method", "complexity", "encl", "encl_line", "class"),
        "funcs": of("def", "name", "line", "class", "complexity"),
        "classes": of("class", "name", "line", "methods", "fields"),
        "scopes": lambda facts: facts["found"].filter(F.col("what") != "file").select(
            *FILE, kind, "name", "indent", F.col("line").alias("start_line"), "end_line"),
        "lines": lambda facts: code_lines(files, materialize),
    })
