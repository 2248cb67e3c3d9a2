"""Query registry and matching oracle SQL."""

from __future__ import annotations

from . import oracles as O
from .queries import QUERIES

ORACLES = {
    "py_lines_indent": O.PY_LINES_INDENT,
    "py_doc_branch_keywords": O.PY_DOC_BRANCH_KEYWORDS,
    "py_funcs": O.PY_FUNCS,
    "py_classes": O.PY_CLASSES,
    "py_god_class": O.PY_GOD_CLASS,
    "py_high_complexity": O.PY_HIGH_COMPLEXITY,
    "go_funcs": O.GO_FUNCS,
    "go_structs": O.GO_STRUCTS,
    "go_god_struct": O.GO_GOD_STRUCT,
    "go_concrete_dep": O.GO_CONCRETE_DEP,
    "go_high_complexity": O.GO_HIGH_COMPLEXITY,
    "findings_all": O.FINDINGS_ALL,
    "repo_score": O.REPO_SCORE,
    "severity_counts": O.SEVERITY_COUNTS,
    "quality_gate": O.QUALITY_GATE,
    "score_band": O.SCORE_BAND,
    "report_json": O.REPORT_JSON,
    "report_json_document": O.REPORT_JSON_DOCUMENT,
    "report_text": O.REPORT_TEXT,
    "report_html_rows": O.REPORT_HTML_ROWS,
    "enrich_prompts": O.ENRICH_PROMPTS,
    "parse_enrichment": O.PARSE_ENRICHMENT,
    "apply_enrichment": O.APPLY_ENRICHMENT,
    "infer_enrichment": O.INFER_ENRICHMENT,
    "infer_packages": O.INFER_PACKAGES,
    "parse_enrichment_body": O.PARSE_ENRICHMENT_BODY,
    "parse_deep": O.PARSE_DEEP,
    "py_skeleton": O.PY_SKELETON,
    "go_skeleton": O.GO_SKELETON,
    "package_sketches": O.PACKAGE_SKETCHES,
    "primitive_obsession_go": O.PRIMITIVE_OBSESSION_GO,
    "primitive_obsession_py": O.PRIMITIVE_OBSESSION_PY,
    "score_history": O.SCORE_HISTORY,
    "findings_by_file": O.FINDINGS_BY_FILE,
    "py_scopes": O.PY_SCOPES,
    "go_params": O.GO_PARAMS,
    "go_calls": O.GO_CALLS,
    "go_imports": O.GO_IMPORTS,
    "package_prompts": O.PACKAGE_PROMPTS,
    "go_summary": O.GO_SUMMARY,
    "py_summary": O.PY_SUMMARY,
    "deep_file_prompts": O.DEEP_FILE_PROMPTS,
    "deep_file_prompts_go": O.DEEP_FILE_PROMPTS_GO,
    "repo_score_with_deep": O.REPO_SCORE_WITH_DEEP,
    "corpus_filter": O.CORPUS_FILTER,
    "ignore_filter": O.IGNORE_FILTER,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
