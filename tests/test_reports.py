import json

from srclens.operators import report as R
from srclens.schemas import FINDINGS


def _findings(spark):
    rows = [
        ("r", "MOYEN", "god_struct", "a/b.go", 3, "S<T>", {"methods": 2, "fields": 11}, "Façade", "Moyen",
         "uses & abuses \"x\" + 'y'", "before", "after"),
        ("r", "CRITIQUE", "high_complexity", "a/c.go", 9, "F", {"cc": 22}, "Stratégie", "Élevé", "", None, "x"),
    ]
    return spark.createDataFrame(rows, FINDINGS)


def test_json_rows(spark):
    f = _findings(spark)
    scores = spark.createDataFrame([("r", 78)], "repo string, score int")
    rows = sorted((r.rank, r.json) for r in R.report_json_rows(f, scores).collect())
    head = json.loads(rows[0][1])
    assert head == {"dir": "r", "score": 78}
    crit = json.loads(rows[1][1])
    assert crit["metrics"] == {"cc": 22} and "explanation" not in crit and "refactor_before" not in crit
    god = json.loads(rows[2][1])
    assert list(god["metrics"]) == ["fields", "methods"] and god["refactor_after"] == "after"


def test_html_rows_escape(spark):
    f = _findings(spark)
    scores = spark.createDataFrame([("r", 78)], "repo string, score int")
    html = {r.rank: r.html for r in R.report_html_rows(f, scores).collect()}
    assert html[-1] == '<div class="score warn">Score de maintenabilité : 78 / 100</div>'
    assert "<td>S&lt;T&gt;</td>" in html[1]
    assert 'class="explanation">uses &amp; abuses &#34;x&#34; &#43; &#39;y&#39;</td>' in html[1]
    assert "explanation" not in html[0]


def test_text_blocks(spark):
    f = _findings(spark)
    scores = spark.createDataFrame([("r", 78)], "repo string, score int")
    counts = spark.createDataFrame([("r", 1, 1, 0)], "repo string, critique long, moyen long, faible long")
    t = {r.rank: r.text for r in R.report_text_rows(f, scores, counts).collect()}
    assert t[0].startswith("[CRITIQUE]             high_complexity      a/c.go:9\n             F · CC=22\n")
    assert "Before:" not in t[0]
    assert "S<T> · 11 champs · 2 méthodes" in t[1]
    assert "             uses & abuses" in t[1]
    assert "Before:\n               before\n\n             After:\n               after" in t[1]
    assert t[3] == "score de maintenabilité : 78 / 100\n  critique : 1  moyen : 1  faible : 0"


def test_json_document(spark):
    f = _findings(spark)
    scores = spark.createDataFrame([("r", 78), ("s", 100)], "repo string, score int")
    rows = R.report_json_document_rows(f, scores).orderBy(*R.SORT_KEY).collect()
    docs = {}
    for r in rows:
        docs[r.repo] = docs.get(r.repo, "") + r.json + "\n"
    r = json.loads(docs["r"])
    assert r["dir"] == "r" and r["score"] == 78 and [x["component"] for x in r["findings"]] == ["F", "S<T>"]
    assert json.loads(docs["s"]) == {"dir": "s", "score": 100, "findings": None}


def test_json_document_with_null_metrics_and_repeats(spark):
    rows = [("r", "MOYEN", "leak", "a.go", 1, "C", None, "p", "Faible", t, "", "") for t in ("one", "one", "two")]
    scores = spark.createDataFrame([("r", 90)], "repo string, score int")
    got = R.report_json_document_rows(spark.createDataFrame(rows, FINDINGS), scores).orderBy(*R.SORT_KEY).collect()
    doc = json.loads("\n".join(r.json for r in got))
    assert [x["explanation"] for x in doc["findings"]] == ["one", "one", "two"]
    assert all(x["metrics"] is None and "refactor_before" not in x for x in doc["findings"])
    assert list(doc["findings"][0])[-4:] == ["metrics", "pattern", "effort", "explanation"]
