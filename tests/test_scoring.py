from pyspark.sql import functions as F

from srclens.operators import scoring as S


def _score(spark, sevs):
    f = spark.createDataFrame([("r", s) for s in sevs], "repo string, severity string")
    repos = spark.createDataFrame([("r",)], "repo string")
    return S.repo_score(f, repos).collect()[0].score


def test_score_cases(spark):
    assert _score(spark, []) == 100
    assert _score(spark, ["CRITIQUE", "CRITIQUE", "MOYEN"]) == 63
    assert _score(spark, ["CRITIQUE"] * 7) == 0
    assert _score(spark, ["FAIBLE"]) == 97
    assert _score(spark, ["CRITIQUE", "MOYEN", "FAIBLE"]) == 75
    assert _score(spark, ["OTHER"]) == 100


def test_counts_gate_band(spark):
    f = spark.createDataFrame([("r", "CRITIQUE"), ("r", "X")], "repo string, severity string")
    repos = spark.createDataFrame([("r",), ("s",)], "repo string")
    c = {r.repo: (r.critique, r.moyen, r.faible, r.other) for r in S.severity_counts(f, repos).collect()}
    assert c == {"r": (1, 0, 0, "X=1"), "s": (0, 0, 0, "")}
    g = S.quality_gate(S.repo_score(f, repos), 90).withColumn("band", S.score_band(F.col("score")))
    got = {r.repo: (r.score, r.failed, r.band) for r in g.collect()}
    assert got == {"r": (85, True, "good"), "s": (100, False, "good")}
    g0 = {r.repo: r.failed for r in S.quality_gate(S.repo_score(f, repos), 0).collect()}
    assert g0 == {"r": False, "s": False}
