"""Registered queries: ``(spark, sf_dir) -> DataFrame``.

Each reads the driver's tables (or a corpus Spark derives from them) in
full, so its work grows with the tables. Map-typed metrics are rendered as
sorted ``k=v`` text so that results compare as plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import metrics_text
from ..operators import detectors as D
from ..operators import scoring as S
from ..operators.gofacts import go_facts
from ..operators.pyfacts import py_facts, py_lines
from ..operators.stage import stage
from ..sources.tables import table
from ..sources.testcorpus import go_corpus, python_corpus

FINDING_VIEW = ["repo", "severity", "smell_type", "file", "line", "component", "metrics",
                "pattern", "effort"]


def findings_view(findings: DataFrame) -> DataFrame:
    return findings.withColumn("metrics", metrics_text(F.col("metrics"))).select(*FINDING_VIEW)


# ------------------------------------------------------------------ Python
def q_py_lines_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repo, files, non-skipped lines and the sum of indent widths."""
    files = python_corpus(spark, sf_dir)
    lines = py_lines(files)
    return (lines.groupBy("repo").agg(
        F.countDistinct("path").alias("files"),
        F.count("*").alias("code_lines"),
        F.sum("indent").cast("long").alias("indent_sum")))


def q_py_doc_branch_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P11 on real prose: keyword counts of ``documents`` per source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"))
    lines = py_lines(docs)
    return (lines.groupBy(F.col("repo").alias("source")).agg(
        F.countDistinct("path").alias("docs"),
        F.count("*").alias("code_lines"),
        F.sum("kw").cast("long").alias("keywords")))


def q_py_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_facts(python_corpus(spark, sf_dir))["funcs"]


def q_py_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_facts(python_corpus(spark, sf_dir))["classes"]


def q_py_god_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(D.py_god_class(py_facts(python_corpus(spark, sf_dir))))


def q_py_high_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(D.py_high_complexity(py_facts(python_corpus(spark, sf_dir))))


# ------------------------------------------------------------------ Go
def q_go_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_facts(go_corpus(spark, sf_dir))["funcs"]


def q_go_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_facts(go_corpus(spark, sf_dir))["structs"]


def q_go_god_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(D.go_god_struct(go_facts(go_corpus(spark, sf_dir))))


def q_go_concrete_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(D.go_concrete_dep(go_facts(go_corpus(spark, sf_dir))))


def q_go_high_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(D.go_high_complexity(go_facts(go_corpus(spark, sf_dir))))


# ------------------------------------------------------------------ both
def analysed_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(findings, repos) of the Python and Go corpora together."""
    from .analysis import analyse
    files = python_corpus(spark, sf_dir).unionByName(go_corpus(spark, sf_dir))
    res = analyse(files)
    return res["findings"], res["repos"]


def q_findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_view(analysed_corpus(spark, sf_dir)[0])


def q_repo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, repos = analysed_corpus(spark, sf_dir)
    return S.repo_score(f, repos)


def q_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, repos = analysed_corpus(spark, sf_dir)
    return S.severity_counts(f, repos)


QUALITY_GATE_MIN = 50


def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, repos = analysed_corpus(spark, sf_dir)
    return S.quality_gate(S.repo_score(f, repos), QUALITY_GATE_MIN)


def q_score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, repos = analysed_corpus(spark, sf_dir)
    return S.repo_score(f, repos).withColumn("band", S.score_band(F.col("score")))


# ------------------------------------------------------------------ reports
def q_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import report_json_rows
    f, repos = analysed_corpus(spark, sf_dir)
    return report_json_rows(f, S.repo_score(f, repos))


def q_report_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import report_json_document_rows
    f, repos = analysed_corpus(spark, sf_dir)
    return report_json_document_rows(f, S.repo_score(f, repos))


def q_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import report_text_rows
    f, repos = analysed_corpus(spark, sf_dir)
    return report_text_rows(f, S.repo_score(f, repos), S.severity_counts(f, repos))


def q_report_html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import report_html_rows
    f, repos = analysed_corpus(spark, sf_dir)
    return report_html_rows(f, S.repo_score(f, repos))


# ------------------------------------------------------------------ model steps
def _py_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = py_facts(python_corpus(spark, sf_dir))
    return D.py_god_class(facts).unionByName(D.py_high_complexity(facts))


def q_enrich_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import enrich_prompts
    return enrich_prompts(_py_findings(spark, sf_dir))


def q_parse_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import parse_enrichment
    from ..sources.testcorpus import enrichment_responses
    return parse_enrichment(enrichment_responses(_py_findings(spark, sf_dir)))


def q_apply_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import apply_enrichment, parse_enrichment
    from ..sources.testcorpus import enrichment_responses
    f = _py_findings(spark, sf_dir)
    out = apply_enrichment(f, parse_enrichment(enrichment_responses(f)))
    return (out.withColumn("metrics", metrics_text(F.col("metrics")))
            .select(*FINDING_VIEW, "explanation", "refactor_before", "refactor_after"))


MODEL_SECONDS = 1.0


def q_infer_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 on all Python findings, with a model that hangs, fails and answers."""
    from ..operators.enrich import enrich_prompts, infer
    from ..sources.testcorpus import stub_enricher
    out = infer(enrich_prompts(_py_findings(spark, sf_dir)), stub_enricher, timeout=MODEL_SECONDS)
    return out.select("finding_id", "raw", "error")


def q_infer_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 on all Python packages: sketch, prompt, call, parse."""
    from ..operators.enrich import infer_packages, package_prompts
    from ..operators.skeleton import package_sketches
    from ..sources.testcorpus import stub_package_analyser
    sketches = package_sketches(python_corpus(spark, sf_dir))
    found = infer_packages(package_prompts(sketches, _py_findings(spark, sf_dir)), stub_package_analyser, timeout=MODEL_SECONDS)
    return found.select("repo", "dir", "elem_pos", "severity", "smell_type", "file", "line", "component", "effort")


def q_parse_enrichment_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4, whole-body rule: the response must be the JSON object and nothing else."""
    from ..operators.enrich import parse_enrichment
    from ..sources.testcorpus import enrichment_responses
    return parse_enrichment(enrichment_responses(_py_findings(spark, sf_dir)), strict_whole_body=True)


def q_parse_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import parse_deep
    from ..sources.testcorpus import deep_responses
    return parse_deep(deep_responses(spark, sf_dir)).drop("metrics", "repo")


def q_repo_score_with_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 + A1: static findings plus the parsed deep-analysis findings of
    each repo, scored together."""
    from ..operators.enrich import append_deep
    from ..operators.enrich import parse_deep
    from ..sources.testcorpus import deep_responses
    f, repos = analysed_corpus(spark, sf_dir)
    allf = append_deep(f, parse_deep(deep_responses(spark, sf_dir)))
    return S.repo_score(allf, repos)


# ------------------------------------------------------------------ skeletons
def q_py_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.skeleton import py_skeleton
    return py_skeleton(python_corpus(spark, sf_dir))


def q_go_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.skeleton import go_skeleton
    return go_skeleton(go_corpus(spark, sf_dir))


def q_package_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.skeleton import package_sketches
    files = python_corpus(spark, sf_dir).unionByName(go_corpus(spark, sf_dir))
    return package_sketches(files).withColumn("files", F.array_join("files", ","))


# ------------------------------------------------------------------ extensions
def q_primitive_obsession_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extensions import go_primitive_obsession
    return findings_view(go_primitive_obsession(go_facts(go_corpus(spark, sf_dir))))


def q_primitive_obsession_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extensions import py_primitive_obsession
    from ..sources.testcorpus import py_shapes
    files = python_corpus(spark, sf_dir).unionByName(py_shapes(spark, sf_dir))
    return findings_view(py_primitive_obsession(files, py_facts(files)["defs"]))


def q_score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extensions import score_history
    scans = table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("user_id") % 25).alias("repo"), F.col("event_id").alias("scan_id"), "ts",
        (F.floor("value").cast("long") % 101).cast("int").alias("score"),
        (F.col("event_id") % 40).cast("int").alias("findings"))
    return score_history(scans).select("repo", "scan_id", "score", "findings", "rank", "trend")


def q_findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extensions import findings_by_file
    return findings_by_file(_py_findings(spark, sf_dir), ["CRITIQUE", "MOYEN"], ["high_complexity"])


# ------------------------------------------------------------------ more facts
def q_py_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_facts(python_corpus(spark, sf_dir))["scopes"]


def q_go_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_facts(go_corpus(spark, sf_dir))["params"]


def q_go_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_facts(go_corpus(spark, sf_dir))["calls"]


def q_go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_facts(go_corpus(spark, sf_dir))["imports"].drop("nth")


def q_package_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import package_prompts
    from ..operators.skeleton import package_sketches
    files = python_corpus(spark, sf_dir).unionByName(go_corpus(spark, sf_dir))
    f, _ = analysed_corpus(spark, sf_dir)
    return package_prompts(package_sketches(files), f)


# ------------------------------------------------------------------ summaries
def q_go_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import go_summary
    return go_summary(go_facts(go_corpus(spark, sf_dir))).select("repo", "path", F.to_json("summary").alias("json"))


def q_py_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import py_summary
    return py_summary(py_facts(python_corpus(spark, sf_dir))).select("repo", "path",
                                                                      F.to_json("summary").alias("json"))


def q_deep_file_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import deep_file_prompts, py_summary
    facts = py_facts(python_corpus(spark, sf_dir))
    f = D.py_god_class(facts).unionByName(D.py_high_complexity(facts))
    return deep_file_prompts(py_summary(facts), f)


def q_deep_file_prompts_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import deep_file_prompts, go_summary
    facts = go_facts(go_corpus(spark, sf_dir))
    return deep_file_prompts(stage(go_summary(facts), "summary"), D.run_all(facts, D.GO_DETECTORS))


def q_corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: directory exclusion of both walkers on paths built from ``part``."""
    from ..sources.corpus import skip_dirs
    from ..sources.testcorpus import part_paths
    p = part_paths(spark, sf_dir)
    py = skip_dirs(p.select("repo", "p_partkey", F.concat("stem", F.lit(".py")).alias("path")), "python")
    go = skip_dirs(p.select("repo", "p_partkey", F.concat("stem", F.lit(".go")).alias("path")), "go")
    return (py.withColumn("lang", F.lit("python")).unionByName(go.withColumn("lang", F.lit("go")))
            .select("repo", "p_partkey", "path", "lang"))


def q_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root ignore rules per repo (derived from ``nation``) applied
    to the Python paths kept by the directory filter."""
    from ..sources.corpus import ignore_filter
    files = q_corpus_filter(spark, sf_dir).filter(F.col("lang") == "python")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    word = F.element_at(F.array(*[F.lit(m) for m in ("medium", "standard", "large", "promo", "small",
                                                      "economy")]),
                        (F.col("n_nationkey") % 6 + 1).cast("int"))
    repo = F.concat(F.lit("r"), F.col("n_nationkey"))
    rules = (nation.select(repo.alias("repo"), F.lit(1).alias("ordinal"), F.lit("app/").alias("pattern"))
             .unionByName(nation.select(repo.alias("repo"), F.lit(2).alias("ordinal"),
                                        F.concat(F.lit("!app/core/*"), word, F.lit(".py")).alias("pattern")))
             .unionByName(nation.select(repo.alias("repo"), F.lit(3).alias("ordinal"), F.lit("/src").alias("pattern"))))
    # A class, an escape, and lines that match nothing: a reversed range, an escaped '#'.
    more = ["vendor/[!a-l\\]]*_steel.py", r"\#note.py", "[z-a]*.py", "# comment"]
    for n, line in enumerate(more):
        rules = rules.unionByName(nation.select(repo.alias("repo"), F.lit(4 + n).alias("ordinal"), F.lit(line).alias("pattern")))
    return ignore_filter(files, rules).select("repo", "p_partkey", "path")


QUERIES = {
    "py_lines_indent": q_py_lines_indent,
    "py_doc_branch_keywords": q_py_doc_branch_keywords,
    "py_funcs": q_py_funcs,
    "py_classes": q_py_classes,
    "py_god_class": q_py_god_class,
    "py_high_complexity": q_py_high_complexity,
    "go_funcs": q_go_funcs,
    "go_structs": q_go_structs,
    "go_god_struct": q_go_god_struct,
    "go_concrete_dep": q_go_concrete_dep,
    "go_high_complexity": q_go_high_complexity,
    "findings_all": q_findings_all,
    "repo_score": q_repo_score,
    "severity_counts": q_severity_counts,
    "quality_gate": q_quality_gate,
    "score_band": q_score_band,
    "report_json": q_report_json,
    "report_json_document": q_report_json_document,
    "report_text": q_report_text,
    "report_html_rows": q_report_html_rows,
    "enrich_prompts": q_enrich_prompts,
    "parse_enrichment": q_parse_enrichment,
    "apply_enrichment": q_apply_enrichment,
    "infer_enrichment": q_infer_enrichment,
    "infer_packages": q_infer_packages,
    "parse_enrichment_body": q_parse_enrichment_body,
    "parse_deep": q_parse_deep,
    "py_skeleton": q_py_skeleton,
    "go_skeleton": q_go_skeleton,
    "package_sketches": q_package_sketches,
    "primitive_obsession_go": q_primitive_obsession_go,
    "primitive_obsession_py": q_primitive_obsession_py,
    "score_history": q_score_history,
    "findings_by_file": q_findings_by_file,
    "py_scopes": q_py_scopes,
    "go_params": q_go_params,
    "go_calls": q_go_calls,
    "go_imports": q_go_imports,
    "package_prompts": q_package_prompts,
    "go_summary": q_go_summary,
    "py_summary": q_py_summary,
    "deep_file_prompts": q_deep_file_prompts,
    "deep_file_prompts_go": q_deep_file_prompts_go,
    "repo_score_with_deep": q_repo_score_with_deep,
    "corpus_filter": q_corpus_filter,
    "ignore_filter": q_ignore_filter,
}
