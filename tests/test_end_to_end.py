import json
import os

from srclens.operators.report import read_report, report_json_document_rows, write_report
from srclens.plans.analysis import analyse_directories, write_reports
from srclens.schemas import FINDINGS


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as fh:
        fh.write(text)


def test_directories_to_reports(spark, tmp_path):
    a, b, empty = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")
    ifs = "\n".join(f"\tif x == {i} {{ x++ }}" for i in range(11))
    _write(a, "svc/h.go", f"package svc\n\ntype H struct {{\n\tdb *DB\n}}\n\nfunc (h *H) Run(x int) int {{\n{ifs}\n\treturn x\n}}\n")
    _write(b, "m.py", "def f(x):\n" + "".join(f"    if x == {i}: pass\n" for i in range(16)))
    _write(empty, "README.md", "nothing")
    res = analyse_directories(spark, {"a": a, "b": b, "c": empty}, min_score=95)
    got = sorted((r.repo, r.smell_type, r.component, r.severity) for r in res["findings"].collect())
    assert got == [("a", "concrete_dep", "H.db", "MOYEN"), ("a", "high_complexity", "H.Run", "FAIBLE"),
                   ("b", "high_complexity", "f", "MOYEN")]
    gate = {r.repo: (r.score, r.failed) for r in res["gate"].collect()}
    assert gate == {"a": (90, True), "b": (93, True)}
    out = str(tmp_path / "out")
    write_reports(res, out, "text")
    text = "".join(read_report(spark, out, "a"))
    assert "[MOYEN]                concrete_dep         svc/h.go:4" in text
    assert "H.db est un type concret, pas une interface" in text
    assert text.rstrip().endswith("critique : 0  moyen : 1  faible : 1")
    out_json = str(tmp_path / "json")
    write_reports(res, out_json, "json")
    doc = json.loads("".join(read_report(spark, out_json, "b")))
    assert doc["dir"] == "b" and doc["score"] == 93 and doc["findings"][0]["metrics"] == {"cc": 17}


def test_a_report_of_many_parts_keeps_its_order(spark, tmp_path):
    rows = [("big" if k % 3 else f"r:{k % 5}", ["CRITIQUE", "MOYEN", "FAIBLE"][k % 3], "s", f"f{k % 40}.go", k, f"C{k}\n", None, "p", "Faible", "", "", "")
            for k in range(3000)]
    findings = spark.createDataFrame(rows, FINDINGS).repartition(7)
    scores = spark.createDataFrame([("big", 0), *((f"r:{k}", 1) for k in range(5)), ("none", 100)], "repo string, score int")
    out = str(tmp_path / "out")
    write_report(report_json_document_rows(findings, scores), out, "json")
    parts = spark.read.parquet(out + "/_manifest").groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in parts}["big"] > 1
    rank = {"CRITIQUE": 0, "MOYEN": 1, "FAIBLE": 2}
    for repo, n in (("big", 2000), ("r:0", 200), ("none", 0)):
        found = json.loads("".join(read_report(spark, out, repo)))["findings"] or []
        keys = [(rank[x["severity"]], x["file"], x["line"]) for x in found]
        assert len(keys) == n and keys == sorted(keys)


def test_stream_of_snapshots(spark, tmp_path):
    from srclens.schemas import SOURCE_FILES
    from srclens.streaming import analyse_stream
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    body = "def f(x):\n" + "".join(f"    if x == {i}: pass\n" for i in range(11))
    spark.createDataFrame([("r", "m.py", "r", "python", body)], SOURCE_FILES).write.parquet(src)
    q = analyse_stream(spark, src, out, ck)
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out).collect()
    assert [(r.repo, r.component, r.metrics["cc"]) for r in rows] == [("r", "f", 12)]
