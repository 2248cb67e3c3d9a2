"""Report sinks S8-S11 and the projections O1, O6, O7.

Reports are row-shaped: one row per finding plus one score row per repo,
each carrying its sort key. Nothing collects a repo's findings into one
array: a global ``orderBy`` on the sort key (range-partitioned, so a repo
with a third of all findings still spreads over many tasks) and
``write.partitionBy("repo").text(...)`` produce the per-repo documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import html_escape
from .scoring import score_band, severity_rank
from .stage import stage

INDENT = " " * 13
SORT_KEY = ["repo", "rank", "file", "line", "smell_type", "component"]


def describe_component(smell: Column, component: Column, metrics: Column) -> Column:
    """god_struct 'X · n champs · m méthodes'; concrete_dep 'X est un
    type concret, pas une interface'; high_complexity 'X · CC=n'; others X."""
    m = F.coalesce(metrics, F.create_map().cast("map<string,int>"))
    fields = F.try_element_at(m, F.lit("fields"))
    methods = F.try_element_at(m, F.lit("methods"))
    cc = F.try_element_at(m, F.lit("cc"))
    god = F.concat_ws(" · ", component,
                      F.when(fields.isNotNull(), F.concat(fields.cast("string"), F.lit(" champs"))),
                      F.when(methods.isNotNull(), F.concat(methods.cast("string"), F.lit(" méthodes"))))
    return (F.when(smell == P.SMELL_GOD_STRUCT, god)
            .when(smell == P.SMELL_CONCRETE_DEP,
                  F.concat(component, F.lit(" est un type concret, pas une interface")))
            .when((smell == P.SMELL_HIGH_COMPLEXITY) & cc.isNotNull(),
                  F.concat(component, F.lit(" · CC="), cc.cast("string")))
            .otherwise(component))


def location(file: Column, line: Column) -> Column:
    """File:line."""
    return F.concat(file, F.lit(":"), line.cast("string"))


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def report_json_rows(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """S8 as JSON lines: per repo a header row (dir, score) and one row per
    finding; empty optional texts are omitted like ``omitempty``, missing
    metrics are written as null."""
    fixed = F.to_json(F.struct(
        "severity", "smell_type", "file", "line", "component",
        F.when(F.col("metrics").isNotNull(), _sorted_map(F.col("metrics"))).alias("metrics"),
        "pattern", "effort"), {"ignoreNullFields": "false"})
    texts = F.to_json(F.struct(
        F.nullif(F.col("explanation"), F.lit("")).alias("explanation"),
        F.nullif(F.col("refactor_before"), F.lit("")).alias("refactor_before"),
        F.nullif(F.col("refactor_after"), F.lit("")).alias("refactor_after")))
    f = findings.select(
        "repo", severity_rank(F.col("severity")).alias("rank"), "file", "line", "smell_type",
        "component",
        F.when(texts == "{}", fixed)
        .otherwise(F.concat(F.regexp_replace(fixed, r"\}$", ","), F.regexp_replace(texts, r"^\{", ""))).alias("json"))
    head = scores.select("repo", F.lit(-1).alias("rank"), F.lit("").alias("file"),
                         F.lit(0).alias("line"), F.lit("").alias("smell_type"),
                         F.lit("").alias("component"),
                         F.to_json(F.struct(F.col("repo").alias("dir"), "score")).alias("json"))
    return head.unionByName(f)


def report_json_document_rows(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """S8 as one JSON document per repo, written line by line:
    ``{"dir":..,"score":..,"findings":[`` / one finding per line, each but
    the first led by a comma / ``]}``; a repo without findings is the single
    line ``{"dir":..,"score":..,"findings":null}``. The first finding of a
    repo comes from a grouped ``min`` of the sort key (map-side combined),
    so no repo is ever gathered in one task; a global sort on the key puts
    the lines in order."""
    rows = report_json_rows(findings, scores).filter(F.col("rank") >= 0)
    place = ["rank", "file", "line", "smell_type", "component"]
    # findings of one place (repeats, or answers of a model) share a line, so places are unique
    rows = (rows.groupBy("repo", *place)
            .agg(F.array_join(F.sort_array(F.collect_list("json")), ",\n").alias("json")))
    key = F.struct(*place)
    first = rows.groupBy("repo").agg(F.min(key).alias("first"))
    body = (rows.join(first, "repo")
            .withColumn("json", F.when(key == F.col("first"), F.col("json"))
                        .otherwise(F.concat(F.lit(","), F.col("json"))))
            .drop("first"))
    has = first.select("repo", F.lit(True).alias("has"))
    heads = scores.join(has, "repo", "left")
    open_ = F.expr("substring(to_json(named_struct('dir', repo, 'score', score)), 1, "
                   "length(to_json(named_struct('dir', repo, 'score', score))) - 1)")
    head = heads.select("repo", F.lit(-1).alias("rank"), F.lit("").alias("file"), F.lit(0).alias("line"),
                        F.lit("").alias("smell_type"), F.lit("").alias("component"),
                        F.when(F.col("has"), F.concat(open_, F.lit(',"findings":[')))
                        .otherwise(F.concat(open_, F.lit(',"findings":null}'))).alias("json"))
    tail = heads.filter("has").select("repo", F.lit(9).alias("rank"), F.lit("").alias("file"), F.lit(0).alias("line"),
                                      F.lit("").alias("smell_type"), F.lit("").alias("component"),
                                      F.lit("]}").alias("json"))
    return head.unionByName(body).unionByName(tail)


def report_text_rows(findings: DataFrame, scores: DataFrame, counts: DataFrame) -> DataFrame:
    """One text block per finding (severity order), then the score block."""
    sev_label = F.concat(F.lit("["), F.col("severity"), F.lit("]"))
    block = F.concat_ws(
        "\n",
        F.format_string("%-22s %-20s %s", sev_label, F.col("smell_type"),
                        location(F.col("file"), F.col("line"))),
        F.concat(F.lit(INDENT), describe_component(F.col("smell_type"), F.col("component"),
                                                   F.col("metrics"))),
        F.concat(F.lit(INDENT + "→ Patron suggéré : "), F.col("pattern"), F.lit(" · Effort : "),
                 F.col("effort")),
        F.lit(""),
        F.when(F.coalesce(F.col("explanation"), F.lit("")) != "",
               F.concat(F.lit(INDENT), F.col("explanation"), F.lit("\n"))),
        F.when((F.coalesce(F.col("refactor_before"), F.lit("")) != "")
               & (F.coalesce(F.col("refactor_after"), F.lit("")) != ""),
               F.concat(F.lit(INDENT + "Before:\n"), _indent(F.col("refactor_before")),
                        F.lit("\n\n" + INDENT + "After:\n"), _indent(F.col("refactor_after")),
                        F.lit("\n"))))
    f = findings.select("repo", severity_rank(F.col("severity")).alias("rank"), "file", "line",
                        "smell_type", "component", block.alias("text"))
    s = (scores.join(counts, "repo")
         .select("repo", F.lit(3).alias("rank"), F.lit("").alias("file"), F.lit(0).alias("line"),
                 F.lit("").alias("smell_type"), F.lit("").alias("component"),
                 F.format_string("score de maintenabilité : %d / 100\n  critique : %d  moyen : %d  faible : %d",
                                 "score", "critique", "moyen", "faible").alias("text")))
    return f.unionByName(s)


def _indent(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, "\n", -1), lambda x: F.concat(F.lit(" " * 15), x)), "\n")


def report_html_rows(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Table rows per finding (plus an explanation row when set) and a
    score line with its band class; the page shell is not built."""
    e = html_escape
    row = F.concat(
        F.lit('<tr><td class="'), e(F.col("severity")), F.lit('">'), e(F.col("severity")),
        F.lit("</td><td>"), e(F.col("smell_type")),
        F.lit("</td><td><code>"), e(location(F.col("file"), F.col("line"))),
        F.lit("</code></td><td>"), e(F.col("component")),
        F.lit("</td><td>"), e(F.col("pattern")),
        F.lit("</td><td>"), e(F.col("effort")), F.lit("</td></tr>"),
        F.when(F.coalesce(F.col("explanation"), F.lit("")) != "",
               F.concat(F.lit('\n<tr><td colspan="6" class="explanation">'), e(F.col("explanation")),
                        F.lit("</td></tr>"))).otherwise(F.lit("")))
    f = findings.select("repo", severity_rank(F.col("severity")).alias("rank"), "file", "line",
                        "smell_type", "component", row.alias("html"))
    s = scores.select("repo", F.lit(-1).alias("rank"), F.lit("").alias("file"), F.lit(0).alias("line"),
                      F.lit("").alias("smell_type"), F.lit("").alias("component"),
                      F.concat(F.lit('<div class="score '), score_band(F.col("score")),
                               F.lit('">Score de maintenabilité : '), F.col("score").cast("string"),
                               F.lit(" / 100</div>")).alias("html"))
    return s.unionByName(f)


def write_report(rows: DataFrame, path: str, column: str) -> None:
    """One text document per repo under ``path/repo=<repo>/``, in report order.

    The rows are range-partitioned by (repo, sort key), so a repo with a third
    of all rows is written by many tasks. The pieces of a document are the
    ``part=<p>`` folders below its repo, p growing with the sort key, one file
    each; ``_manifest`` (Parquet) lists repo, part, rows and first sort key of
    every piece, which ``read_report`` follows. The numbered rows are staged
    first, so a task that is run again writes the same piece."""
    order = [F.col(c) for c in SORT_KEY]
    spark = rows.sparkSession
    dealt = stage(rows.select(*SORT_KEY, F.col(column).alias("value")), "report")
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "report")
    # Sorted by the folder columns first: the writer then keeps this order as it is.
    pieces = dealt.repartition("part").sortWithinPartitions("repo", "part", *order[1:])
    pieces.select("value", "repo", "part").write.mode("overwrite").partitionBy("repo", "part").text(path)
    first = F.min(F.struct(*SORT_KEY[1:])).alias("first")
    dealt.groupBy("repo", "part").agg(F.count("*").alias("n_rows"), first).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")


def read_report(spark: SparkSession, path: str, repo: str) -> Iterator[str]:
    """A repo's document, piece by piece in order, as the manifest lists them; one piece at a time is on the driver."""
    root = path.rstrip("/")
    text = spark.read.schema("value string, repo string, part int").text(root, wholetext=True)
    pieces = spark.read.parquet(f"{root}/_manifest").filter(F.col("repo") == repo).orderBy("part").select("part")
    for piece in pieces.toLocalIterator():
        found = text.filter((F.col("repo") == repo) & (F.col("part") == piece.part)).collect()
        if len(found) != 1:
            raise ValueError(f"piece {piece.part} of {repo} has {len(found)} files, not one")
        yield found[0].value
