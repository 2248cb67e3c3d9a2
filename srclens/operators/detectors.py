"""Detectors D1-D6: filters and CASE expressions over fact tables.

Each detector is a function ``facts -> findings DataFrame``; the registry
(``GO_DETECTORS``, ``PY_DETECTORS``) is the extension point: add a callable
that returns the findings schema and ``run_all`` unions it in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..schemas import FINDING_COLUMNS



def _finding(df: DataFrame, *, severity: Column, smell: str, file: Column, line: Column,
             component: Column, metrics: Column, pattern: str, effort: Column) -> DataFrame:
    return df.select(
        F.col("repo"),
        severity.alias("severity"),
        F.lit(smell).alias("smell_type"),
        file.alias("file"),
        line.cast("int").alias("line"),
        component.alias("component"),
        metrics.cast("map<string,int>").alias("metrics"),
        F.lit(pattern).alias("pattern"),
        effort.alias("effort"),
        F.lit(None).cast("string").alias("explanation"),
        F.lit(None).cast("string").alias("refactor_before"),
        F.lit(None).cast("string").alias("refactor_after"),
    )


def cc_severity(cc: Column) -> Column:
    return (F.when(cc > 20, F.lit(P.CRITIQUE)).when(cc > 15, F.lit(P.MOYEN))
            .otherwise(F.lit(P.FAIBLE)))


def cc_effort(cc: Column) -> Column:
    return (F.when(cc > 20, F.lit(P.EFFORT_HIGH)).when(cc > 15, F.lit(P.EFFORT_MEDIUM))
            .otherwise(F.lit(P.EFFORT_LOW)))


def _god(fields: Column, methods: Column) -> tuple[Column, Column, Column]:
    flag = (fields > P.FIELD_THRESHOLD) | (methods > P.METHOD_THRESHOLD)
    big = (fields > 2 * P.FIELD_THRESHOLD) | (methods > 2 * P.METHOD_THRESHOLD)
    return (flag, F.when(big, F.lit(P.CRITIQUE)).otherwise(F.lit(P.MOYEN)),
            F.when(big, F.lit(P.EFFORT_HIGH)).otherwise(F.lit(P.EFFORT_MEDIUM)))


# ---------------------------------------------------------------- Python
def py_god_class(facts: dict[str, DataFrame]) -> DataFrame:
    """Classes with methods > 15 or fields > 10."""
    c = facts["classes"]
    flag, sev, eff = _god(F.col("fields"), F.col("methods"))
    return _finding(c.filter(flag), severity=sev, smell=P.SMELL_GOD_CLASS, file=F.col("path"),
                    line=F.col("line"), component=F.col("name"),
                    metrics=F.create_map(F.lit("methods"), F.col("methods"),
                                         F.lit("fields"), F.col("fields")),
                    pattern=P.PATTERN_FACADE, effort=eff)


def py_high_complexity(facts: dict[str, DataFrame]) -> DataFrame:
    """Functions with cc > 10; component Class.func or func."""
    f = facts["funcs"]
    cc = F.col("complexity")
    comp = F.when(F.col("class") != "", F.concat_ws(".", "class", "name")).otherwise(F.col("name"))
    return _finding(f.filter(cc > P.CC_THRESHOLD), severity=cc_severity(cc),
                    smell=P.SMELL_HIGH_COMPLEXITY, file=F.col("path"), line=F.col("line"),
                    component=comp, metrics=F.create_map(F.lit("cc"), cc),
                    pattern=P.PATTERN_STRATEGY, effort=cc_effort(cc))


# ---------------------------------------------------------------- Go
def go_god_struct(facts: dict[str, DataFrame]) -> DataFrame:
    """Structs with fields > 10 or methods > 15 (methods across the package)."""
    s = facts["structs"]
    flag, sev, eff = _god(F.col("fields"), F.col("methods"))
    return _finding(s.filter(flag), severity=sev, smell=P.SMELL_GOD_STRUCT, file=F.col("path"),
                    line=F.col("line"), component=F.col("name"),
                    metrics=F.create_map(F.lit("fields"), F.col("fields"),
                                         F.lit("methods"), F.col("methods")),
                    pattern=P.PATTERN_FACADE, effort=eff)


def go_concrete_dep(facts: dict[str, DataFrame]) -> DataFrame:
    """Injectable-named fields holding a concrete type."""
    d = facts["concrete_fields"]
    return _finding(d, severity=F.lit(P.MOYEN), smell=P.SMELL_CONCRETE_DEP, file=F.col("path"),
                    line=F.col("line"), component=F.concat_ws(".", "struct", "first_name"),
                    metrics=F.create_map().cast("map<string,int>"),
                    pattern=P.PATTERN_DI, effort=F.lit(P.EFFORT_LOW))


def go_high_complexity(facts: dict[str, DataFrame]) -> DataFrame:
    """D3: function declarations with cc > 10; component Recv.Func or Func."""
    f = facts["funcs"]
    cc = F.col("complexity")
    comp = F.when(F.coalesce(F.col("recv_cc"), F.lit("")) != "",
                  F.concat_ws(".", "recv_cc", "name")).otherwise(F.col("name"))
    return _finding(f.filter(cc > P.CC_THRESHOLD), severity=cc_severity(cc),
                    smell=P.SMELL_HIGH_COMPLEXITY, file=F.col("path"), line=F.col("line"),
                    component=comp, metrics=F.create_map(F.lit("cc"), cc),
                    pattern=P.PATTERN_STRATEGY, effort=cc_effort(cc))


Detector = Callable[[dict[str, DataFrame]], DataFrame]

GO_DETECTORS: dict[str, Detector] = {
    P.SMELL_GOD_STRUCT: go_god_struct,
    P.SMELL_CONCRETE_DEP: go_concrete_dep,
    P.SMELL_HIGH_COMPLEXITY: go_high_complexity,
}
PY_DETECTORS: dict[str, Detector] = {
    P.SMELL_GOD_CLASS: py_god_class,
    P.SMELL_HIGH_COMPLEXITY: py_high_complexity,
}


def run_all(facts: dict[str, DataFrame], detectors: dict[str, Detector]) -> DataFrame | None:
    """Union of every detector's findings (UNION ALL, no dedupe)."""
    out = None
    for det in detectors.values():
        df = det(facts).select(*FINDING_COLUMNS)
        out = df if out is None else out.unionByName(df)
    return out
