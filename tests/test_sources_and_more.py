import os

from pyspark.sql import functions as F

from srclens.operators import enrich as E
from srclens.operators.extensions import go_primitive_obsession, py_primitive_obsession, score_history
from srclens.operators.gofacts import go_facts
from srclens.operators.pyfacts import py_facts
from srclens.operators.skeleton import go_skeleton, py_skeleton
from srclens.sources.corpus import ignore_filter, ignore_regex, scan_directories, scan_directory


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as fh:
        fh.write(text)


def test_scan_skip_and_ignore(spark, tmp_path):
    root = str(tmp_path)
    for rel in ["a.py", "pkg/b.py", "venv/lib/c.py", "x.egg-info/d.py", "build/e.py", "gen/f.py",
                "keep/g.py", "notes.txt"]:
        _write(root, rel, "def f():\n    pass\n")
    files = scan_directory(spark, root, "r", "python")
    assert sorted(r.path for r in files.collect()) == ["a.py", "gen/f.py", "keep/g.py", "pkg/b.py"]
    rules = spark.createDataFrame([("r", 1, "gen/"), ("r", 2, "*.py"), ("r", 3, "!keep/*.py"), ("r", 4, "# c")],
                                  "repo string, ordinal int, pattern string")
    kept = sorted(r.path for r in ignore_filter(files, rules).collect())
    assert kept == ["keep/g.py"]


def test_ignore_regex(spark):
    lines = ["# x", "  ", "!a", "/build", r"\#x", "*.py[co]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, pattern string")
    got = [r.c and tuple(r.c) for r in df.select("i", ignore_regex(F.col("pattern")).alias("c")).orderBy("i").collect()]
    assert got[:4] == [None, None, ("^(?:.*/)?a(?:/.*)?$", True), ("^build(?:/.*)?$", False)]


def test_ignore_classes_escapes_and_many_rules(spark):
    paths = ["a.pyc", "a.py", "d/b.pyo", "#x", "d/x", "src/m1.py", "src/m2.py", "src/mA.py", "a+b.py", "q[1].py"]
    files = spark.createDataFrame([(r, p) for r in ("r", "s") for p in paths], "repo string, path string")
    rules = ["*.py[co]", r"\#x", "/src/m[!0-9].py", "src/m[2].py", "a+b.py", r"q\[1].py", "[", "[]x].none"]
    rows = [("r", i, x) for i, x in enumerate(rules)] + [(f"o{k % 9}", k, "*.py") for k in range(500)]
    kept = ignore_filter(files, spark.createDataFrame(rows, "repo string, ordinal int, pattern string"))
    assert kept.columns == files.columns
    got = sorted((r.repo, r.path) for r in kept.collect())
    assert got == sorted([("s", p) for p in paths] + [("r", p) for p in ("a.py", "d/x", "src/m1.py")])


def test_one_scan_of_many_roots_reads_kept_files_only(spark, tmp_path):
    roots = {}
    for k in range(100):
        root = roots[f"r{k}"] = str(tmp_path / "build" / f"r{k}")
        for rel in ["a.py", "pkg/b.go", "venv/c.py", "vendor/d.go", "gen/e.py", "gen/keep.py"]:
            _write(root, rel, f"x = {k}")
        _write(root, ".gitignore", "# none\ngen/*\n!gen/keep.py\n[z-a].py\n" if k % 2 else "*.txt\n")
    with open(os.path.join(roots["r1"], "latin.py"), "wb") as fh:
        fh.write("é = 1".encode("latin-1"))
    df = scan_directories(spark, {**roots, "inner": roots["r0"] + "/pkg"})
    plan = df._jdf.queryExecution().executedPlan()
    assert plan.toString().count("FileScan") == 1
    got = sorted((r.repo, r.path, r.lang, r.content) for r in df.collect())
    want = [("inner", "b.go", "go", "x = 0"), ("r0", "gen/e.py", "python", "x = 0"), ("r1", "latin.py", "python", "\ufffd = 1")]
    for k in range(100):
        want += [(f"r{k}", p, "python", f"x = {k}") for p in ["a.py", "gen/keep.py"] + ([] if k % 2 or k == 0 else ["gen/e.py"])]
        want += [(f"r{k}", "pkg/b.go", "go", f"x = {k}")] if k else []
    assert got == sorted(want)
    assert {r.dir for r in df.filter("path = 'pkg/b.go' and repo = 'r5'").collect()} == {"r5/pkg"}
    leaves = plan.collectLeaves()
    assert leaves.apply(0).metrics().apply("numFiles").value() == len(want)


def test_ignore_classes_that_are_not_valid(spark):
    paths = ["a.py", "].py", "b.py", "z.py", "^.py", "-.py", "q&.py", "m/b.py"]
    files = spark.createDataFrame([("r", p, i) for i, p in enumerate(paths)], "repo string, path string, __salt int")
    rules = ["[z-a].py", "[a\\]b].py", "[!-z^a-m&]q.py", "[&&z].py", "[]"]
    kept = ignore_filter(files.drop("__salt"), spark.createDataFrame([("r", i, x) for i, x in enumerate(rules)], "repo string, ordinal int, pattern string"))
    assert sorted(r.path for r in kept.collect()) == sorted(["^.py", "-.py", "q&.py"])


def test_skeletons(files):
    df = files({"a.py": "class A:\n    def m(self):\n        x = 1\n\n    def n(self):\n        pass\n",
                "b.go": "package p\n\nfunc F() {\n\tx := 1\n\t_ = x\n}\n"})
    assert py_skeleton(df).collect()[0].skeleton == "class A:\n    def m(self):\n        ...\n    def n(self):\n        ..."
    assert go_skeleton(df).collect()[0].skeleton == "package p\n\nfunc F() { /* 2 lines */ }\n"


def test_parsers(spark):
    resp = spark.createDataFrame([("a", 'x {"explanation":"e","effort":"Moyen"} y'),
                                  ("b", '{"explanation": 1}'), ("c", "nothing"),
                                  ("d", '{"explanation":"e2","refactor_before":"b","refactor_after":"a","effort":""}'),
                                  ("e", '{"Explanation":"ci","EFFORT":"Faible"}'), ("f", '{"Effort": 3}')],
                                 "finding_id string, raw string")
    got = {r.finding_id: (r.explanation, r.effort) for r in E.parse_enrichment(resp).collect()}
    assert got == {"a": ("e", "Moyen"), "d": ("e2", ""), "e": ("ci", "Faible")}
    deep = spark.createDataFrame([
        (1, "f.go", 'ok [{"smell_type":"x","severity":"moyen","line":3,"effort":"Élevé"}] done'),
        (2, "f.go", '[{"line":"3"}]'), (3, "f.go", '[{"line":3.5}]'), (4, "g.go", '[{"file":"h.go"}, {}]'),
        (5, "f.go", '[{"Line":7,"SEVERITY":"critique"}]'), (6, "f.go", '[{"LINE":"7"}]')],
        "id int, default_file string, raw string")
    rows = sorted((r.id, r.elem_pos, r.severity, r.file, r.line, r.effort) for r in E.parse_deep(deep).collect())
    assert rows == [(1, 0, "MOYEN", "f.go", 3, "Élevé"), (4, 0, "FAIBLE", "h.go", 0, "Faible"),
                    (4, 1, "FAIBLE", "g.go", 0, "Faible"), (5, 0, "CRITIQUE", "f.go", 7, "Faible")]


def test_infer_hook(spark):
    prompts = spark.createDataFrame([("a", "p1"), ("b", "p2")], "finding_id string, prompt string")
    out = E.infer(prompts, lambda s: s.str.upper())
    assert sorted((r.finding_id, r.raw) for r in out.collect()) == [("a", "P1"), ("b", "P2")]


def test_infer_keeps_keys_contains_errors_and_writes_once(spark, tmp_path):
    def model(prompts):
        if prompts.str.contains("bad").any():
            raise RuntimeError("refused")
        return prompts.str.upper()

    prompts = spark.createDataFrame([("r", "d1", "ok"), ("r", "d2", "bad"), ("s", "d1", "fine")],
                                    "repo string, dir string, prompt string").coalesce(1)
    out = E.infer(prompts, model, table=f"file://{tmp_path}/responses")
    assert out.columns == ["repo", "dir", "raw", "error"] and out.inputFiles()
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("r", "d1", "OK", None), ("r", "d2", None, "RuntimeError: refused"), ("s", "d1", "FINE", None)]


def test_infer_limits_calls_and_resumes(spark, tmp_path):
    log, table = str(tmp_path / "calls"), f"file://{tmp_path}/answers"
    os.makedirs(log)

    def model(prompts, stop=()):
        import time
        import uuid
        for p in prompts:
            open(f"{log}/{p}-{uuid.uuid4().hex}", "w").close()
            if p.startswith("slow"):
                time.sleep(3600)
            if p.startswith("bad"):
                raise RuntimeError("refused")
        return prompts.str.upper()

    def called():
        return sorted(n.split("-")[0] for n in os.listdir(log))
    rows = [(i, p) for i, p in enumerate(["a", "b", "slow1", "bad1", "a", None])]
    first = spark.createDataFrame(rows, "id int, prompt string")
    got = sorted(map(tuple, E.infer(first, model, table, timeout=1.0, wave=2).collect()))
    want = [(0, "A", None), (1, "B", None), (2, None, "no answer in 1 s"), (3, None, "RuntimeError: refused"), (4, "A", None), (5, None, None)]
    assert got == want and called() == ["a", "b", "bad1", "slow1"]
    assert sorted(map(tuple, E.infer(first, model, table, timeout=1.0).collect())) == want and len(called()) == 4
    more = first.union(spark.createDataFrame([(6, "c")], "id int, prompt string"))
    assert sorted(map(tuple, E.infer(more, model, table, timeout=1.0).collect()))[-1] == (6, "C", None)
    assert called() == ["a", "b", "bad1", "c", "slow1"]
    better = E.infer(more, lambda p: p + "!", table, retry_failed=True).collect()
    assert {r.id: r.raw for r in better} == {0: "A", 1: "B", 2: "slow1!", 3: "bad1!", 4: "A", 5: None, 6: "C"}


def test_infer_reads_a_prompt_for_its_own_wave_only(spark, monkeypatch):
    staged, real = {}, E.stage

    def keep(df, name="facts", **options):
        staged[name] = real(df, name, **options)
        return staged[name]
    monkeypatch.setattr(E, "stage", keep)
    prompts = spark.range(40).selectExpr("id", "concat('p', id % 20) prompt")
    got = E.infer(prompts, lambda s: s.str.upper(), wave=4).collect()
    assert sorted((r.id, r.raw) for r in got) == [(i, f"P{i % 20}") for i in range(40)]
    todo = staged["todo"]
    assert todo.count() == 20 and todo.select("wave").distinct().count() > 1
    assert all("/wave=" in f for f in todo.inputFiles())


def test_apply_enrichment_with_repeated_responses(spark):
    findings = spark.createDataFrame([("r", "a.go", 1, "x", "C", "", "", "", "Faible")],
                                     "repo string, file string, line int, smell_type string, component string, "
                                     "explanation string, refactor_before string, refactor_after string, effort string")
    fid = findings.select(E.finding_id(findings)).first()[0]
    parsed = spark.createDataFrame([(fid, "e2", "b", "a", ""), (fid, "e1", "b", "a", "Moyen")],
                                   "finding_id string, explanation string, refactor_before string, refactor_after string, effort string")
    got = E.apply_enrichment(findings, parsed).collect()
    assert [(r.explanation, r.effort) for r in got] == [("e1", "Moyen")]


def test_primitive_obsession(files):
    go = "package p\n\ntype U struct {\n\tUserID int\n\tEmail string\n\tPhoneNo string\n\tx int\n}\n"
    py = "class U:\n    def __init__(self, user_id, user_email, home_url, x):\n        pass\n"
    df = files({"u.go": go, "u.py": py})
    g = [(r.component, r.metrics["primitive_fields"]) for r in go_primitive_obsession(go_facts(df, False)).collect()]
    assert g == [("U", 3)]
    facts = py_facts(df, False)
    p = [(r.component, r.metrics["primitive_fields"])
         for r in py_primitive_obsession(df, facts["defs"]).collect()]
    assert p == [("U.__init__", 3)]


def test_score_history_salted(spark):
    rows = [("r", i, i, i % 7) for i in range(100)] + [("s", 1, 1, 5)]
    scans = spark.createDataFrame(rows, "repo string, scan_id long, ts long, score int")
    got = score_history(scans, k=3, salt_buckets=4).orderBy("repo", "rank").collect()
    assert [(r.repo, r.scan_id, r.rank) for r in got] == [("r", 99, 1), ("r", 98, 2), ("r", 97, 3), ("s", 1, 1)]
    assert got[0].trend == (99 % 7) - (98 % 7)


def test_a_python_skeleton_moves_the_files_once(files):
    src = "\n".join(["class A:", "", "    def m(self):", "", "        x = 1", "        def n():", "            return 2", "        return n",
                     "    async def o(self): pass", "", "y = 1", ""])
    want = "\n".join(["class A:", "", "    def m(self):", "        ...", "        def n():", "            ...", "    async def o(self): pass", "y = 1", ""])
    df = files({"p/a.py": src, "p/b.py": "\n\n"})
    sk = py_skeleton(df)
    assert {r.path: r.skeleton for r in sk.collect()} == {"p/a.py": want, "p/b.py": "\n\n"}
    assert sk._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # in the first and the final plan
    # Files of one name are read as one; files without a name keep their code.
    twice = py_skeleton(files({"q.py": "def f():\n    x\n"}).union(files({"q.py": "def f():\n    x\n"})))
    assert [r.skeleton for r in twice.collect()] == ["def f():\ndef f():\n    ..."]
    odd = py_skeleton(files({"q.py": "def f():\n\n    x\n"}).selectExpr("repo", "cast(null as string) path", "dir", "lang", "content"))
    assert [r.skeleton for r in odd.collect()] == ["def f():\n    x"]


def test_signatures_run_patterns_where_needed(files):
    from srclens.operators.extensions import py_signatures
    src = "x = 1\ndef a(u, v): pass\n\ndef b(\n  u='(',  # (\n  v=\"d)ef\"\n):\n    y = u\n    undefined\n"
    sig = py_signatures(files({"s.py": src}))
    assert sorted((r.line, r.signature) for r in sig.collect()) == [(2, "def a(u, v): pass"), (4, "def b(   u= ,      v=  ):")]
    assert "Contains(raw" in sig._jdf.queryExecution().optimizedPlan().toString()


def test_calls_share_a_thread_until_one_hangs(monkeypatch):
    import threading
    import time

    from srclens.operators import enrich
    started = []
    thread = threading.Thread

    def counted(*args, **kwargs):
        started.append(1)
        return thread(*args, **kwargs)

    def model(prompts):
        def answer(p):
            if p == "hangs":
                time.sleep(60)
            if p == "fails":
                raise ValueError("refused")
            return p.upper()
        return prompts.map(answer)
    monkeypatch.setattr(enrich.threading, "Thread", counted)
    asked = ["a", "fails", "hangs", "b", "hangs"] + ["c"] * 500
    got = enrich._answers(model, asked, 0.5)
    assert got == [("A", None), (None, "ValueError: refused"), (None, "no answer in 0.5 s"), ("B", None), (None, "no answer in 0.5 s")] + [("C", None)] * 500
    assert len(started) == 3
    assert enrich._answers(model, [], 0.5) == [] and enrich._answers(model, ["d"], None) == [("D", None)]


def test_sketches_are_made_once_for_package_prompts(files):
    from srclens.operators.enrich import package_prompts
    from srclens.operators.skeleton import package_sketches
    df = files({"p/a.py": "def f(x):\n    return x\n"})
    found = df.sparkSession.createDataFrame([("repo", "p/a.py", 1, "s", "f")], "repo string, file string, line int, smell_type string, component string")
    prompts = package_prompts(package_sketches(df), found)
    assert "posexplode" not in prompts._jdf.queryExecution().optimizedPlan().toString()
    assert "s at line 1 in a.py (f)" in prompts.first().prompt


def test_skeletons_move_no_lines(files):
    from srclens.operators.skeleton import go_skeleton, py_skeleton
    py = py_skeleton(files({"m.py": "class A:\n    def m(self):\n        x = 1\n\n        y = 2\n\nz = 3\n"}))
    go = go_skeleton(files({"p/a.go": "package p\n\nfunc A(s string) (é int) { // {é\n\tx := `}\n}` + \"}\"\n\treturn 1 /* é } */ } // end\nvar é = 1\n"}))
    for df in (py, go):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan
    # The blank lines in and behind the body are left out, as the def is open until the next line of code.
    assert py.first().skeleton == "class A:\n    def m(self):\n        ...\nz = 3\n"
    assert go.first().skeleton == "package p\n\nfunc A(s string) (é int) { /* 2 lines */ } // end\nvar é = 1\n"


def test_skeletons_of_files_of_one_key(spark):
    from srclens.operators.skeleton import go_skeleton, py_skeleton
    a, g = "def f():\n    x = 1\n\ny = 2", "package p\n\nfunc A() {\n\tx := 1\n}"
    rows = [("r", "p.py", "d", "python", a), ("r", "p.py", "d", "python", a), (None, None, None, "python", a), (None, "a.go", "d", "go", g)]
    df = spark.createDataFrame(rows, "repo string, path string, dir string, lang string, content string")
    got = {r.path: r.skeleton for r in py_skeleton(df).collect()}
    assert got["p.py"] == "def f():\ndef f():\n    ...\ny = 2\ny = 2"
    assert got[None] == "def f():\n    x = 1\ny = 2"  # nothing is cut without a name, but blank lines go
    assert go_skeleton(df).first().skeleton == g


def test_scanned_signatures_are_those_of_the_lines(files):
    from srclens.operators.extensions import py_signatures, scanned_signatures
    df = files({"s.py": "x = 1\ndef a(u, v): pass\n\ndef b(\n  u='(',  # (\n  v=\"d)ef\"\n):\n    def c(\n  def d(): #(\r\n", "t.py": "\"x\" def e(f\\\n)\nundef g():\n", "u.py": ""})
    df = df.union(df.filter("path = 's.py'"))
    scanned = scanned_signatures(df)
    assert "Window" not in scanned._jdf.queryExecution().optimizedPlan().toString()
    got, want = (sorted((r.path, r.line, r.signature) for r in d.collect()) for d in (scanned, py_signatures(df)))
    assert got == want and len(want) == 9
