"""File summaries G16 / P16 and the per-file deep prompt L3.

A summary is one nested row per file, assembled from the fact tables with
grouped ``collect_list`` of structs (each group is one file's own types or
functions) and joins on the file key; empty lists are omitted like
``omitempty``. Prompts carry the row as JSON indented by two spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_indented


def _none_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _func_node(prefix: str = "") -> Column:
    return F.struct(F.col("name"), F.col("line"), _none_if_empty(F.col("params")).alias("params"),
                    F.nullif(F.col("complexity"), F.lit(0)).alias("complexity"),
                    F.nullif(F.col("lines"), F.lit(0)).alias("lines"),
                    _none_if_empty(F.col("calls")).alias("calls"))


def go_summary(facts: dict[str, DataFrame]) -> DataFrame:
    """File, package, imports, struct types (fields, methods) and
    standalone functions per Go file. A method whose receiver type is not a
    struct of the same file gets a stub type (line 0)."""
    facts["detail"]  # one scan for all that is read here
    files = facts["packages"].select("repo", "path", "package")
    imps = (facts["imports"].groupBy("repo", "path")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "nth", "import_path"))),
                             lambda x: x["import_path"]).alias("imports")))
    params = (facts["params"]
              .withColumn("p", F.when(F.col("name").isNotNull(), F.concat_ws(" ", "name", "type"))
                          .otherwise(F.col("type")))
              .groupBy("repo", "path", "line")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"]).alias("params")))
    calls = (facts["calls"].groupBy("repo", "path", F.col("func_line").alias("line"))
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "call"))), lambda x: x["call"])
                  .alias("calls")))
    funcs = (facts["funcs"].join(params, ["repo", "path", "line"], "left")
             .join(calls, ["repo", "path", "line"], "left")
             .withColumn("params", F.coalesce("params", F.array().cast("array<string>")))
             .withColumn("calls", F.coalesce("calls", F.array().cast("array<string>"))))
    structs = facts["types"].filter((F.col("kind") == "struct") & F.col("top"))
    fields = (facts["fields"]
              .withColumn("fl", F.when(F.col("embedded"), F.array(F.struct(F.col("type").alias("name"),
                                                                           F.col("type").alias("type"))))
                          .otherwise(F.transform("names", lambda n: F.struct(n.alias("name"), F.col("type").alias("type")))))
              .groupBy("repo", "path", "head_pos")
              .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("field_no", "fl"))), lambda x: x["fl"]))
                   .alias("fields")))
    methods = (funcs.filter(F.col("recv_cc").isNotNull())
               .groupBy("repo", "path", F.col("recv_cc").alias("name"))
               .agg(F.sort_array(F.collect_list(F.struct("line", "name", "params", "complexity", "lines", "calls")))
                    .alias("ms"), F.min("line").alias("first_method")))
    types = (structs.select("repo", "path", "name", "line", "head_pos")
             .join(fields, ["repo", "path", "head_pos"], "left").drop("head_pos")
             .join(methods, ["repo", "path", "name"], "full")
             .withColumn("stub", F.col("line").isNull())
             .withColumn("order", F.when(F.col("stub"), F.lit(1)).otherwise(F.lit(0)))
             .withColumn("node", F.struct(
                 "name", F.lit("struct").alias("kind"), F.coalesce("line", F.lit(0)).alias("line"),
                 _none_if_empty(F.coalesce("fields", F.array())).alias("fields"),
                 _none_if_empty(F.transform(F.coalesce("ms", F.array()), lambda m: F.struct(
                     m["name"].alias("name"), m["line"].alias("line"),
                     _none_if_empty(m["params"]).alias("params"),
                     F.nullif(m["complexity"], F.lit(0)).alias("complexity"),
                     F.nullif(m["lines"], F.lit(0)).alias("lines"),
                     _none_if_empty(m["calls"]).alias("calls")))).alias("methods")))
             .groupBy("repo", "path")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(
                 "order", F.coalesce("line", "first_method").alias("at"), "node"))), lambda x: x["node"])
                  .alias("types")))
    plain = (funcs.filter(F.col("recv_cc").isNull())
             .groupBy("repo", "path")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("line", _func_node().alias("n")))),
                              lambda x: x["n"]).alias("funcs")))
    out = (files.join(imps, ["repo", "path"], "left")
           .join(types, ["repo", "path"], "left").join(plain, ["repo", "path"], "left"))
    summary = F.struct(F.col("path").alias("file"), F.nullif(F.col("package"), F.lit("")).alias("package"),
                       "imports", "types", "funcs")
    return out.select("repo", "path", summary.alias("summary"))


def py_summary(facts: dict[str, DataFrame]) -> DataFrame:
    """Classes with their methods and functions without class; when a
    class name is declared twice the last declaration gets the methods."""
    classes = facts["classes"]
    last = classes.groupBy("repo", "path", "name").agg(F.max("line").alias("owner"))
    methods = (facts["funcs"].filter(F.col("class") != "")
               .groupBy("repo", "path", F.col("class").alias("name"))
               .agg(F.sort_array(F.collect_list(F.struct("line", "name", "complexity"))).alias("ms")))
    owned = last.join(methods, ["repo", "path", "name"]).select("repo", "path", F.col("owner").alias("line"), "ms")
    types = (classes.join(owned, ["repo", "path", "line"], "left")
             .groupBy("repo", "path")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(
                 "line", F.struct("name", F.lit("class").alias("kind"), "line",
                                  _none_if_empty(F.transform(F.coalesce("ms", F.array()), lambda m: F.struct(
                                      m["name"].alias("name"), m["line"].alias("line"),
                                      F.nullif(m["complexity"], F.lit(0)).alias("complexity"))))
                                  .alias("methods")).alias("n")))), lambda x: x["n"]).alias("types")))
    plain = (facts["funcs"].filter(F.col("class") == "")
             .groupBy("repo", "path")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(
                 "line", F.struct("name", "line", F.nullif(F.col("complexity"), F.lit(0)).alias("complexity"))
                 .alias("n")))), lambda x: x["n"]).alias("funcs")))
    out = facts["files"].join(types, ["repo", "path"], "left").join(plain, ["repo", "path"], "left")
    return out.select("repo", "path", F.struct(F.col("path").alias("file"), "types", "funcs").alias("summary"))


def deep_file_prompts(summaries: DataFrame, findings: DataFrame) -> DataFrame:
    """L3 + J5: per-file prompt from the indented JSON summary and the findings
    of that file, for Go and Python files alike."""
    from ..functions import patterns as P
    skip = (findings.groupBy("repo", F.col("file").alias("path"))
            .agg(F.sort_array(F.collect_list(F.struct("line", "smell_type", "component"))).alias("sk")))
    lines = F.transform("sk", lambda x: F.format_string("  - %s at line %d (%s)\n", x["smell_type"], x["line"],
                                                        x["component"]))
    skip_txt = F.when(F.size(F.coalesce("sk", F.array())) > 0,
                      F.concat(F.lit(P.PROMPT_FILE_SKIP), F.array_join(lines, ""), F.lit("\n"))).otherwise(F.lit(""))
    return (summaries.join(skip, ["repo", "path"], "left")
            .select("repo", "path", F.concat(F.lit(P.PROMPT_FILE_HEAD), skip_txt, F.lit(P.PROMPT_FILE_TAIL),
                                             json_indented(F.col("summary"), summaries.schema["summary"].dataType))
                    .alias("prompt")))
