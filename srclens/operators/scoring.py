"""Aggregations A1-A5 and the severity order O1.

All are plain grouped aggregates: partial aggregation runs map-side, so the
shuffle carries one row per (partition, repo) however many findings exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def severity_rank(sev: Column) -> Column:
    """O1: CRITIQUE 0, MOYEN 1, anything else 2."""
    return F.when(sev == P.CRITIQUE, 0).when(sev == P.MOYEN, 1).otherwise(2)


def penalty(sev: Column) -> Column:
    expr = F.when(sev == P.CRITIQUE, P.SCORE_PENALTY[P.CRITIQUE])
    expr = expr.when(sev == P.MOYEN, P.SCORE_PENALTY[P.MOYEN])
    return expr.when(sev == P.FAIBLE, P.SCORE_PENALTY[P.FAIBLE]).otherwise(0)


def repo_score(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """A1: max(0, 100 - 15*CRITIQUE - 7*MOYEN - 3*FAIBLE) per repo; 100 without findings.

    ``repos`` holds one row per repo that has source files (the no-source
    guard S7: a repo without files gets no row at all).
    """
    pen = findings.groupBy("repo").agg(F.sum(penalty(F.col("severity"))).alias("pen"))
    return (repos.select("repo").distinct().join(pen, "repo", "left")
            .select("repo", F.greatest(F.lit(0), F.lit(100) - F.coalesce("pen", F.lit(0)))
                    .cast("int").alias("score")))


def severity_counts(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """A2: the three severity counts per repo, zero-filled, and ``other``:
    any other severity string with its count, as sorted ``k=v`` text."""
    known = F.col("severity").isin(*P.SEVERITIES)
    agg = findings.groupBy("repo").agg(
        F.count_if(F.col("severity") == P.CRITIQUE).alias("critique"),
        F.count_if(F.col("severity") == P.MOYEN).alias("moyen"),
        F.count_if(F.col("severity") == P.FAIBLE).alias("faible"))
    other = (findings.filter(~known & F.col("severity").isNotNull())
             .groupBy("repo", "severity").agg(F.count("*").alias("n"))
             .groupBy("repo")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("severity", "n"))),
                                           lambda x: F.concat(x["severity"], F.lit("="), x["n"].cast("string"))),
                               ", ").alias("other")))
    return (repos.select("repo").distinct().join(agg, "repo", "left").join(other, "repo", "left")
            .select("repo", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                              for c in ("critique", "moyen", "faible")],
                    F.coalesce("other", F.lit("")).alias("other")))


def quality_gate(scores: DataFrame, min_score: int) -> DataFrame:
    """A4: ``failed`` when min_score > 0 and score < min_score."""
    return scores.withColumn("failed", F.lit(min_score > 0) & (F.col("score") < F.lit(min_score)))


def score_band(score: Column) -> Column:
    """A5: good (>= 80), warn (>= 60), bad."""
    return (F.when(score >= P.SCORE_GOOD, F.lit("good")).when(score >= P.SCORE_WARN, F.lit("warn"))
            .otherwise(F.lit("bad")))
