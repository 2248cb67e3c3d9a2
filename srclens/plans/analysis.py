"""The static analysis plan: source table -> facts -> findings -> scores.

``analyse`` is the Spark form of one run of the analysed tool, for any
number of repositories at once. Findings are staged (checkpointed) once
because scores, counts and every report read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import scoring as S
from ..operators.gofacts import go_facts
from ..operators.pyfacts import py_facts
from ..operators.stage import stage


def analyse(files: DataFrame, min_score: int = 0) -> dict[str, DataFrame]:
    """Run every registered detector of both languages over ``files``
    (repo, path, dir, lang, content). Returns findings, repos, scores,
    counts and the quality gate."""
    parts = []
    gf = go_facts(files)
    parts.append(D.run_all(gf, D.GO_DETECTORS))
    pf = py_facts(files)
    parts.append(D.run_all(pf, D.PY_DETECTORS))
    findings = parts[0]
    for p in parts[1:]:
        findings = findings.unionByName(p)
    findings = stage(findings, "findings")
    # Repos with at least one analysable file, from the staged lines: the texts are not read again.
    repos = gf["packages"].select("repo").union(pf["files"].select("repo")).distinct()
    scores = S.repo_score(findings, repos)
    return {
        "findings": findings,
        "repos": repos,
        "scores": scores,
        "counts": S.severity_counts(findings, repos),
        "gate": S.quality_gate(scores, min_score),
        "go_facts": gf,
        "py_facts": pf,
    }


def analyse_directories(spark, roots: dict[str, str], min_score: int = 0) -> dict[str, DataFrame]:
    """The static run for many roots at once: one scan of the ``.go`` and
    ``.py`` files below each root (repo name -> folder) with its excluded
    directories and ignore file, then analyse, score and gate. Repos without
    any source file get no row (S7)."""
    from ..sources.corpus import scan_directories
    return analyse(scan_directories(spark, roots), min_score)


def write_reports(result: dict[str, DataFrame], out_dir: str, fmt: str = "json") -> None:
    """One document per repo under ``out_dir/repo=<repo>/`` in the
    chosen format: ``json`` (one JSON document per repo), ``jsonl`` (a
    header line and one JSON line per finding), ``text``, or ``html`` table
    rows. ``report.read_report`` reads a repo's document back in order."""
    from ..operators import report as R
    f, scores = result["findings"], result["scores"]
    if fmt == "json":
        rows, col = R.report_json_document_rows(f, scores), "json"
    elif fmt == "jsonl":
        rows, col = R.report_json_rows(f, scores), "json"
    elif fmt == "html":
        rows, col = R.report_html_rows(f, scores), "html"
    else:
        rows, col = R.report_text_rows(f, scores, result["counts"]), "text"
    R.write_report(rows, out_dir, col)
