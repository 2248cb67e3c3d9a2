"""Python facts on small sources and on sources generated from a plan."""

import random

from srclens.operators import detectors as D
from pyspark.sql import functions as F

from srclens.operators.pyfacts import py_facts


def _facts(files, src):
    f = py_facts(files({"m.py": src}), materialize=False)
    classes = sorted((r.name, r.line, r.methods, r.fields) for r in f["classes"].collect())
    funcs = sorted((r.name, r.line, r["class"], r.complexity) for r in f["funcs"].collect())
    return classes, funcs


def test_class_methods_and_fields(files):
    src = """class UserService:
    def __init__(self, db):
        self.db = db
        self.cache = {}

    def get(self, id):
        return self.db.get(id)

    def save(self, user):
        pass

    def delete(self, id):
        pass
"""
    classes, _ = _facts(files, src)
    assert classes == [("UserService", 1, 4, 2)]


def test_two_classes(files):
    src = "class A:\n    def a(self):\n        pass\n    def b(self):\n        pass\n\nclass B:\n    def c(self):\n        pass\n"
    classes, _ = _facts(files, src)
    assert [(c[0], c[2]) for c in classes] == [("A", 2), ("B", 1)]


def test_function_complexity(files):
    src = "def process(data):\n    if data:\n        pass\n    if not data:\n        pass\n"
    _, funcs = _facts(files, src)
    assert funcs == [("process", 1, "", 3)]


def test_method_complexity(files):
    src = """class OrderProcessor:
    def process(self, order):
        if order.valid and order.paid:
            for item in order.items:
                if item.stock > 0 or item.backorder:
                    pass
        elif order.pending:
            while order.retry():
                pass
        try:
            pass
        except ValueError:
            pass
"""
    _, funcs = _facts(files, src)
    assert funcs == [("process", 2, "OrderProcessor", 9)]


def test_empty_file(files):
    assert _facts(files, "") == ([], [])


def test_inheritance(files):
    classes, _ = _facts(files, "class Animal:\n    pass\n\nclass Dog(Animal):\n    pass\n")
    assert [c[0] for c in classes] == ["Animal", "Dog"]


def test_quirks(files):
    src = """class A:
    def m(self):
        def inner(v):
            return v and v
        if x: pass
    @staticmethod
    def s(x):
        return x or x
    async def f(self):
        if y: pass
class A:
    def n(cls):
        pass
"""
    classes, funcs = _facts(files, src)
    assert classes == [("A", 1, 1, 0), ("A", 11, 1, 0)]
    assert funcs == [("inner", 3, "", 2), ("m", 2, "A", 1), ("n", 12, "A", 1), ("s", 7, "", 2)]


def test_accented_word_boundary(files):
    _, funcs = _facts(files, "def f():\n    x = 'éor'\n    y = 'éif_'\n")
    assert funcs == [("f", 1, "", 2)]


def test_god_class_and_complexity_findings(files):
    body = "\n".join(f"    def m{i}(self):\n        pass" for i in range(16))
    init = "\n".join(f"        self.f{i} = {i}" for i in range(11))
    src = f"class G:\n    def __init__(self):\n{init}\n{body}\n"
    f = py_facts(files({"g.py": src}), materialize=False)
    got = [(r.component, r.severity, dict(r.metrics)) for r in D.py_god_class(f).collect()]
    assert got == [("G", "MOYEN", {"methods": 17, "fields": 11})]


# Sources written from a plan whose facts are known before any text is.
def _planned(rng):
    """(source, class facts, function facts) of random top-level classes and functions."""
    lines, classes, funcs = [], [], []

    def body(pad, branches):
        for k in range(branches):
            lines.append(f"{pad}if v{k}:")
            lines.append(f"{pad}    pass")
        lines.append(f"{pad}pass")

    for k in range(rng.randint(1, 6)):
        lines.extend(rng.choice([[], [""], ["# note: if and or"], ["", ""]]))
        if rng.random() < 0.5:
            n = rng.randint(0, 5)
            lines.append(f"def free{k}(a, b):")
            funcs.append((f"free{k}", len(lines), "", 1 + n))
            body("    ", n)
            continue
        at, methods, fields = len(lines) + 1, rng.randint(1, 4), rng.randint(0, 3)
        lines.append(f"class Kind{k}:")
        for m in range(methods):
            n = rng.randint(0, 4)
            name = f"step{m}" if m else "__init__"
            lines.append(f"    def {name}(self, x):")
            funcs.append((name, len(lines), f"Kind{k}", 1 + n))
            if m == 0:
                lines.extend(f"        self.part{j} = {j}" for j in range(fields))
            elif m == 1:  # fields are counted in __init__ only
                lines.append("        self.late = x")
            body("        ", n)
        classes.append((f"Kind{k}", at, methods, fields))
    return "\n".join(lines) + "\n", sorted(classes), sorted(funcs)


def test_planned_sources(files):
    rng = random.Random(11)
    plans = {f"f{i}.py": _planned(rng) for i in range(40)}
    f = py_facts(files({p: src for p, (src, _, _) in plans.items()}), materialize=False)
    classes, funcs = {}, {}
    for r in f["classes"].collect():
        classes.setdefault(r.path, []).append((r.name, r.line, r.methods, r.fields))
    for r in f["funcs"].collect():
        funcs.setdefault(r.path, []).append((r.name, r.line, r["class"], r.complexity))
    for path, (src, want_classes, want_funcs) in plans.items():
        assert sorted(classes.get(path, [])) == want_classes, src
        assert sorted(funcs.get(path, [])) == want_funcs, src


def test_files_are_in_order_before_their_lines_are_cut(files):
    from srclens.operators.pyfacts import cluster_files
    df = cluster_files(files({"b.py": "x", "a.py": "y"}))
    assert "Sort [repo" in df._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_counted_where_any_is(spark):
    from srclens.functions.text import py_keyword_count
    rows = [("", 0), ("elif x", 1), ("for y", 1), ("orb = band", 0), ("while a and b or c", 3), ("except E: pass", 1), ("x = 1", 0), (None, None)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", py_keyword_count(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_only_lines_that_may_close_a_scope_keep_the_indents(files):
    src = "class A:\n    def m(self):\n        x = 1\n    y = 2\nz = 3\n"
    lines = py_facts(files({"m.py": src}))["lines"]
    got = {r.line: (sorted(r.cls_thr or []), sorted(r.hdr_thr or [])) for r in lines.collect()}
    assert got == {1: ([0], [0, 4]), 2: ([0], [0, 4]), 3: ([], []), 4: ([], [0, 4]), 5: ([0], [0, 4])}


def test_python_lines_need_three_window_passes(files):
    lines = py_facts(files({"a.py": "class A:\n    def f(self):\n        if x: pass\n"}), materialize=False)["lines"]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 3


def test_python_corpus_groups_texts_by_a_count_that_grows(spark, tmp_path):
    from srclens.sources.testcorpus import python_corpus
    spark.createDataFrame([(1, 2), (3, 4)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, 2, 5.0), (10, 1, 3.0)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    was = spark.conf.get("srclens.files.partitions")
    try:
        spark.conf.set("srclens.files.partitions", "13")
        made = python_corpus(spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("srclens.files.partitions", was)
    assert ", 13), REPARTITION_BY_NUM" in plan
    texts = {r.path: r.content for r in made.collect()}
    assert set(texts) == {"r2/p0/c_1.py", "r4/p0/c_3.py"}
    assert texts["r2/p0/c_1.py"].index("m_10_1(") < texts["r2/p0/c_1.py"].index("m_10_2(")


def test_python_facts_move_no_lines(files):
    f = py_facts(files({"m.py": "class A:\n    def m(self):\n        pass\n"}), materialize=False)
    for name in ("files", "defs", "funcs", "classes", "scopes"):
        plan = f[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan and "Join" not in plan, name


def test_files_of_one_key_are_one_file_in_line_order(spark):
    a = "class A:\n    def m(self):\n        if x: pass\n"
    rows = [("r", "p.py", "python", a), ("r", "p.py", "python", a), (None, None, "python", a), ("r", "q.py", "python", "def f():\n    if x: pass\n")]
    f = py_facts(spark.createDataFrame(rows, "repo string, path string, lang string, content string"))
    got = sorted((str(r.path), r.name, r.line, r["class"], r.complexity) for r in f["funcs"].collect())
    # Both defs come before both bodies; a file without a name has no class around its def.
    assert got == [("None", "m", 2, "", 2), ("p.py", "m", 2, "A", 1), ("p.py", "m", 2, "A", 3), ("q.py", "f", 1, "", 2)]
    assert sorted((str(r.path), r.methods) for r in f["classes"].collect()) == [("None", 0), ("p.py", 2), ("p.py", 2)]
    assert sorted(str(r.path) for r in f["files"].collect()) == ["None", "p.py", "p.py", "q.py"]


def test_lines_that_begin_with_rare_white_space(files):
    src = "\x0cclass A:\n\u3000 \x0b def m(self):\n  \r\n        if x or y: pass\n\u2003# if\n\xa0\n\n"
    classes, funcs = _facts(files, src)
    # The indent ends at the first character that is neither a space nor a tab.
    assert classes == [("A", 1, 0, 0)] and funcs == [("m", 2, "", 3)]


def test_a_scan_is_the_same_in_any_pieces(monkeypatch):
    import pyarrow as pa

    from srclens.operators import filescan, pyscan
    rng = random.Random(5)
    rows = [("r", f"f{i:03d}.py", _planned(rng)[0]) for i in range(30)]
    rows[7] = rows[7][:2] + ("",)
    rows.insert(9, rows[8])

    def found(chunk, size):
        monkeypatch.setattr(filescan, "CHUNK", chunk)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("repo", "path", "content"), r)) for r in rows[k:k + size]]) for k in range(0, len(rows), size)]
        return sorted((r for b in pyscan.scan(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["path"], r["what"], r["line"] or 0, str(r)))
    assert found(1 << 21, 100) == found(1, 1) == found(700, 4)
