"""Go facts and detectors on small sources."""

import pytest

from srclens.operators import detectors as D
from srclens.operators.gofacts import go_facts, go_params


def _func_with(body_lines, name="f", recv=""):
    body = "\n".join("\t" + b for b in body_lines)
    head = f"func {recv}{name}(x int) int {{" if not recv else f"func ({recv}) {name}(x int) int {{"
    return f"package p\n\n{head}\n{body}\n\treturn x\n}}\n"


def _cc_findings(files, src):
    facts = go_facts(files({"p/a.go": src}))
    return [(r.severity, r.metrics["cc"], r.component) for r in D.go_high_complexity(facts).collect()]


@pytest.mark.parametrize("n_if,expected", [
    (0, None), (9, None), (10, (11, "FAIBLE")), (11, (12, "FAIBLE")), (16, (17, "MOYEN")),
    (21, (22, "CRITIQUE")),
])
def test_complexity_if_counts(files, n_if, expected):
    src = _func_with([f"if x == {i} {{ x++ }}" for i in range(n_if)])
    got = _cc_findings(files, src)
    if expected is None:
        assert got == []
    else:
        assert got == [(expected[1], expected[0], "f")]


def test_complexity_logical_ops(files):
    src = _func_with(["y := x > 0 " + "&& x > 1 " * 10, "_ = y"])
    assert _cc_findings(files, src) == [("FAIBLE", 11, "f")]


def test_complexity_loops(files):
    src = _func_with(["for i := 0; i < x; i++ { }", "for _, v := range []int{1} { _ = v }"]
                     + [f"if x == {i} {{ }}" for i in range(8)])
    assert _cc_findings(files, src) == [("FAIBLE", 11, "f")]


def test_complexity_switch(files):
    lines = ["switch x {"] + [f"case {i}:" for i in range(10)] + ["default:", "}"]
    lines += [f"if x == {i} {{ }}" for i in range(10)]
    assert _cc_findings(files, _func_with(lines)) == [("CRITIQUE", 21, "f")]


def test_complexity_method_component(files):
    src = _func_with([f"if x == {i} {{ }}" for i in range(11)], name="Process", recv="s *Svc")
    assert _cc_findings(files, src) == [("FAIBLE", 12, "Svc.Process")]


def test_complexity_ignores_literals_and_comments(files):
    src = _func_with(['s := "if && || {"', "r := '{'", "t := `if { case`", "// if if if",
                      "/* for { */"] + [f"if x == {i} {{ }}" for i in range(10)])
    assert _cc_findings(files, src) == [("FAIBLE", 11, "f")]


def _struct(n_fields, extra=""):
    fields = "\n".join(f"\tF{i} int" for i in range(n_fields))
    return f"package p\n\ntype Big struct {{\n{fields}\n{extra}}}\n"


def _god(files, sources):
    facts = go_facts(files(sources))
    return sorted((r.component, r.severity, r.metrics["fields"], r.metrics["methods"])
                  for r in D.go_god_struct(facts).collect())


@pytest.mark.parametrize("n,expected", [(3, None), (10, None), (11, "MOYEN"), (21, "CRITIQUE")])
def test_god_struct_fields(files, n, expected):
    got = _god(files, {"p/a.go": _struct(n)})
    assert got == ([] if expected is None else [("Big", expected, n, 0)])


def test_god_struct_embedded_and_names(files):
    src = "package p\n\nimport \"sync\"\n\ntype Big struct {\n\tsync.Mutex\n\ta, b, c, d, e int\n\tf, g, h, i, j, k string\n}\n"
    assert _god(files, {"p/a.go": src}) == [("Big", "MOYEN", 12, 0)]


def test_god_struct_non_struct(files):
    assert _god(files, {"p/a.go": "package p\n\ntype MyInt int\n"}) == []


@pytest.mark.parametrize("ptr", ["", "*"])
def test_god_struct_methods(files, ptr):
    methods = "\n".join(f"func (s {ptr}Svc) M{i}() {{}}" for i in range(16))
    src = f"package p\n\ntype Svc struct {{\n\ta int\n}}\n\n{methods}\n"
    assert _god(files, {"p/a.go": src}) == [("Svc", "MOYEN", 1, 16)]


def test_god_struct_two_files(files):
    a = _struct(11) + "\nfunc (b *Big) A() {}\n"
    b = "package p\n\nfunc (b *Big) B() {}\n"
    assert _god(files, {"p/a.go": a, "p/b.go": b}) == [("Big", "MOYEN", 11, 2)]


def _deps(files, body):
    src = f"package p\n\ntype OrderHandler struct {{\n{body}\n}}\n"
    facts = go_facts(files({"p/a.go": src}))
    return sorted((r.component, r.severity, r.effort) for r in D.go_concrete_dep(facts).collect())


@pytest.mark.parametrize("body,expected", [
    ("\tdb *PostgresDB", [("OrderHandler.db", "MOYEN", "Faible")]),
    ("\tsvc *UserService", [("OrderHandler.svc", "MOYEN", "Faible")]),
    ("\tcount *BigInt", []),
    ("\tdb int", []),
    ("\tdb *PostgresDB\n\tcache *RedisCache\n\tlogger *ZapLogger",
     [("OrderHandler.cache", "MOYEN", "Faible"), ("OrderHandler.db", "MOYEN", "Faible"),
      ("OrderHandler.logger", "MOYEN", "Faible")]),
    ("\t*Base", []),
    ("\tX, Y float64", []),
])
def test_concrete_dep(files, body, expected):
    assert _deps(files, body) == expected


def test_concrete_dep_resolves_declared_types(files):
    src = ("package p\n\ntype Store struct{ a int }\n\ntype Repo interface{ Get() }\n\n"
           "type H struct {\n\tdb Store\n\trepo *Repo\n\tcache *Store\n}\n")
    facts = go_facts(files({"p/a.go": src}))
    got = sorted(r.component for r in D.go_concrete_dep(facts).collect())
    assert got == ["H.cache", "H.db"]


def test_imports_params_calls(files):
    from srclens.operators.gofacts import go_calls, go_params
    src = ('package p\n\nimport (\n\t"fmt"\n\tlg "log"\n)\n\nimport "os"\n\n'
           'func (s *S) Do(a, b int, c string, f func(x int) error) (int, error) {\n'
           '\tfmt.Println(a)\n\tlg.Printf("%d", b)\n\tfmt.Println(c)\n\tos.Exit(1)\n\ts.x.Y()\n\treturn 0, nil\n}\n'
           'func U(int, string) {}\n')
    facts = go_facts(files({"p/a.go": src}))
    lines = facts["lines"]
    imps = sorted(((r.alias, r.import_path) for r in facts["imports"].collect()), key=lambda x: x[1])
    assert imps == [(None, "fmt"), ("lg", "log"), (None, "os")]
    calls = [r.call for r in go_calls(lines).orderBy("rank").collect()]
    assert calls == ["fmt.Println", "lg.Printf", "os.Exit"]
    ps = sorted(((r.func, r.idx, r.name, r.type) for r in go_params(lines).collect()),
                key=lambda x: (x[0], x[1]))
    assert ps[:3] == [("Do", 0, "a", "int"), ("Do", 1, "b", "int"), ("Do", 2, "c", "string")]
    assert ("U", 0, None, "int") in ps and ("U", 1, None, "string") in ps


def test_field_type_text(files):
    src = ("package p\n\ntype T struct {\n\tm map[string]int\n\tc chan int\n\ta [5]*Node\n"
           "\tf func(x int) error\n\ti interface{ Get() }\n\tn struct {\n\t\tX int\n\t}\n\tq *pkg.Q `json:\"q\"`\n}\n")
    facts = go_facts(files({"p/a.go": src}))
    got = {tuple(r.names): r.type for r in facts["fields"].collect()}
    assert got == {("m",): "map[string]int", ("c",): "chan int", ("a",): "[]*Node", ("f",): "func(...)",
                   ("i",): "interface{}", ("n",): "?", ("q",): "*pkg.Q"}


def test_randomized_functions(files):
    """Random functions with decoys; complexity and line known by construction."""
    import random
    pieces = [("if x > 0 {\n\tx++\n}", 1), ("for i := 0; i < 3; i++ {\n}", 1), ("x = a && b", 1),
              ("y = a || b && c", 2), ('s := "if && { case"', 0), ("// for case {", 0), ("/* if {\n for */", 0),
              ("r := '{'", 0), ("switch x {\ncase 1:\ncase 2, 3:\ndefault:\n}", 2),
              ("f := func() bool { return a && b }", 1), ("t := `if\n{ case`", 0),
              ("select {\ncase <-ch:\ndefault:\n}", 1), ("if a {\n} else if b {\n}", 2)]
    rng = random.Random(5)
    sources, expected = {}, {}
    for n in range(40):
        lines, exp = ["package p", ""], []
        for j in range(rng.randint(1, 4)):
            recv = rng.choice(["", "(s *S) ", "(s S) "])
            start = len(lines) + 1
            body, cc = [], 1
            for _ in range(rng.randint(0, 8)):
                text, c = rng.choice(pieces)
                body.extend("\t" + part for part in text.split("\n"))
                cc += c
            lines.append(f"func {recv}F{j}(x int) int {{")
            lines.extend(body)
            lines.extend(["\treturn x", "}", ""])
            exp.append((("S." if recv else "") + f"F{j}", start, cc))
        sources[f"p/f{n}.go"] = "\n".join(lines)
        expected[f"p/f{n}.go"] = sorted(exp)
    facts = go_facts(files(sources))
    got = {}
    for r in facts["funcs"].collect():
        comp = (r.recv_cc + "." if r.recv_cc else "") + r.name
        got.setdefault(r.path, []).append((comp, r.line, r.complexity))
    for path, exp in expected.items():
        assert sorted(got.get(path, [])) == exp, (path, sources[path])


def test_randomized_structs(files):
    import random
    rng = random.Random(9)
    field_kinds = [("{n} int", 1), ("{n}, {n}x string", 2), ("Base{i}", 1), ("*pkg.T{i}", 1),
                   ('{n} []byte `json:"{n}"`', 1), ("{n} map[string]struct{{ a int }}", 1),
                   ("{n} struct {{\n\t\tX int\n\t\tY int\n\t}}", 1), ("db *Store", 1), ("{n} func(a, b int) error", 1)]
    sources, expected = {}, {}
    for f in range(25):
        out, exp, deps = ["package p", "", "type Store struct{ a int }", ""], {}, []
        decls = []
        for s in range(rng.randint(1, 4)):
            name = f"S{f}_{s}"
            fields, count, has_db = [], 0, 0
            for i in range(rng.randint(0, 6)):
                text, c = rng.choice(field_kinds)
                fields.append(text.format(n=f"f{i}", i=i))
                count += c
                has_db += text.startswith("db ")
            decls.append((name, fields, count, has_db))
        group = rng.random() < 0.5
        if group:
            out.append("type (")
        for name, fields, count, has_db in decls:
            generic = rng.random() < 0.3
            head = f"{name}[T any]" if generic else name
            kw = "" if group else "type "
            start = len(out) + 1
            if not fields and rng.random() < 0.5:
                out.append(f"{kw}{head} struct{{}}")
            elif len(fields) <= 2 and all("\n" not in x and "`" not in x for x in fields) and rng.random() < 0.4:
                out.append(f"{kw}{head} struct{{ " + "; ".join(fields) + " }")
            else:
                out.append(f"{kw}{head} struct {{")
                for x in fields:
                    out.extend("\t" + part for part in x.split("\n"))
                out.append("}")
            exp[name] = (start, count)
            deps.extend([f"{name}.db"] * has_db)
        if group:
            out.append(")")
        n_methods = rng.randint(0, 3)
        target = decls[0][0]
        for m in range(n_methods):
            out.append(f"func (x *{target}) M{m}() {{}}")
        sources[f"p{f}/a.go"] = "\n".join(out) + "\n"
        expected[f"p{f}/a.go"] = ({k: (v[0], v[1], n_methods if k == target else 0) for k, v in exp.items()},
                                  sorted(deps))
    facts = go_facts(files(sources))
    got = {}
    for r in facts["structs"].collect():
        got.setdefault(r.path, {})[r.name] = (r.line, r.fields, r.methods)
    deps = {}
    for r in D.go_concrete_dep(facts).collect():
        deps.setdefault(r.file, []).append(r.component)
    for path, (exp, exp_deps) in expected.items():
        g = {k: v for k, v in got.get(path, {}).items() if k != "Store"}
        assert g == exp, (path, sources[path])
        assert sorted(deps.get(path, [])) == exp_deps, (path, sources[path])


# ---------------------------------------------------------------- names, scopes, signatures
def _sources(files, sources):
    rows = files({f"r/{p}": text for p, text in sources.items()}, repo="r")
    return go_facts(rows)


def test_qualified_defined_and_generic_types_are_resolved(files):
    facts = _sources(files, {
        "store/pg.go": "package store\n\ntype PG struct{ id int }\n\ntype Reader interface{ Read() int }\n\ntype Wrapped PG\n",
        "deep/store/x.go": "package store\n\ntype PG interface{ Do() }\n",
        "dots/d.go": "package dots\n\ntype Dotted struct{ a int }\n",
        "app/a.go": ("package app\n\nimport (\n\t\"fmt\"\n\tst \"example.com/m/store\"\n\t\"example.com/m/deep/store\"\n"
                     "\t. \"example.com/m/dots\" // \"not/this\"\n)\n\n"
                     "type real struct{ a int }\n\ntype A real\ntype B A\ntype C B\ntype D st.Wrapped\ntype Al = real\ntype FromAl Al\n"
                     "type Loop1 Loop2\ntype Loop2 Loop1\ntype Num int\ntype Gen[K comparable, V any] struct{ v V }\ntype Set[T any] map[T]int\n\n"
                     "type H[T any] struct {\n\tcache *st.PG\n\trepo st.Reader\n\tstore store.PG\n\tdb C\n\tclient D\n\tqueue Al\n\tbus FromAl\n"
                     "\tmanager Loop1\n\tlogger Num\n\tsvc *Gen[int, string]\n\tservice Set[int]\n\thandler T\n\tpublisher *T\n"
                     "\trepository Dotted\n\tdatabase *string\n\tClient *http.Client\n\tDB [4]real\n\tCache **real\n\tStore *Unknown\n}\n"),
    })
    got = sorted(r.component for r in D.go_concrete_dep(facts).collect())
    assert got == sorted(["H.cache", "H.db", "H.client", "H.bus", "H.svc", "H.repository", "H.Store"])


def test_slices_arrays_and_local_structs(files):
    src = ("package p\n\ntype Cases []struct {\n\ta, b int\n}\ntype Five [5]struct{ a int }\ntype Many [N]struct{ a int }\n"
           "type Fn func(x struct{ a int }) error\n\nfunc a() {\n\ttype args struct {\n\t\tx int\n\t\ty, z int\n\t}\n\t_ = args{}\n}\n\n"
           "func b() {\n\ttype args struct {\n\t\tw int\n\t}\n\ttype (\n\t\tinner struct{ a, b int }\n\t)\n}\n\ntype Last struct{ Gen[int]; *pkg.T; q [3]int }\n")
    facts = _sources(files, {"p/a.go": src})
    got = {r.name: (r.line, r.fields) for r in facts["structs"].collect()}
    assert got == {"args": (19, 1), "inner": (23, 2), "Last": (27, 3)}
    from srclens.operators.summary import go_summary
    summary = go_summary(facts).first().summary
    assert [t.name for t in summary.types] == ["Last"]
    assert [f.type for f in summary.types[0].fields] == ["?", "*pkg.T", "[]int"]


def test_names_beyond_ascii(files):
    src = "package p\n\ntype Été struct {\n\tdb *Clé\n}\n\ntype Clé struct{ a int }\n\nfunc (é *Été) Évaluer(\n\ta int,\n\tb string) int {\n\téif := a\n\tif éif > 0 {\n\t}\n\treturn é.Calculé()\n}\n"
    facts = _sources(files, {"p/a.go": src})
    assert [(r.recv, r.name, r.line, r.lines, r.complexity) for r in facts["funcs"].collect()] == [("Été", "Évaluer", 9, 8, 2)]
    assert [r.component for r in D.go_concrete_dep(facts).collect()] == ["Été.db"]
    from srclens.operators.gofacts import go_calls
    assert [r.call for r in go_calls(facts["lines"]).collect()] == ["é.Calculé"]


def test_signatures_over_lines(files):
    from srclens.operators.gofacts import go_params
    src = ("package p\n\nfunc (s *S[K]) Run(\n\tctx context.Context, // a, b\n\ta, b int,\n\tcb func(x int, y string) (int, error),\n"
           "\tm map[struct{ k int }][]func(),\n\topts ...Option[int],\n) (n int, err error) {\n}\n\n"
           "func F[T any, U interface{ ~int }](t T, xs [3]T, ch <-chan int, g Gen[T], p *(int)) T { return g(t, 1) }\n\n"
           "func G(int, Gen[int], ...string, map[string]int, func(a int) error, interface{ M(x int) }, chan<- int) {}\n\nfunc H() (a, b int) { return }\n")
    facts = _sources(files, {"p/a.go": src})
    got = {}
    for r in sorted(go_params(facts["lines"]).collect(), key=lambda r: (r.line, r.idx)):
        got.setdefault(r.func, []).append((r.name, r.type))
    assert got == {
        "Run": [("ctx", "context.Context"), ("a", "int"), ("b", "int"), ("cb", "func(...)"), ("m", "map[?][]func(...)"), ("opts", "...?")],
        "F": [("t", "T"), ("xs", "[]T"), ("ch", "chan int"), ("g", "?"), ("p", "*?")],
        "G": [(None, x) for x in ("int", "?", "...string", "map[string]int", "func(...)", "interface{}", "chan int")]}


def test_a_very_long_line_and_test_files(files):
    long_line = "\tx := []int{" + "1, " * 700_000 + "}"
    wide = "type W struct { " + "; ".join(f"f{i} int" for i in range(60_000)) + " }"
    facts = _sources(files, {"p/a.go": f"package p\n\n{wide}\n\nfunc F() {{\n{long_line}\n\tif a {{\n\t}}\n}}\n", "p/a_test.go": _struct(30)})
    assert [(r.name, r.fields) for r in facts["structs"].collect()] == [("W", 60_000)]
    assert [(r.name, r.complexity, r.lines) for r in facts["funcs"].collect()] == [("F", 2, 5)]


def test_a_skeleton_moves_the_files_once(files):
    from srclens.operators.skeleton import go_skeleton
    sk = go_skeleton(files({"p/a.go": "package p\n\nfunc A() {\n\tx := 1\n}\n\nfunc B() { return }\n"}))
    assert sk.first().skeleton == "package p\n\nfunc A() { /* 1 lines */ }\n\nfunc B() { return }\n"
    plan = sk._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_lines_of_a_body_without_facts_are_not_staged(files):
    facts = go_facts(files({"p/a.go": "package p\n\nfunc A(a, b int) {\n\tx := 1\n\tif a && b { y() }\n\tz := &x\n}\n"}))
    assert sorted(r.line for r in facts["lines"].collect()) == [1, 2, 3, 5, 7]
    assert [(r.name, r.line, r.lines, r.complexity) for r in facts["funcs"].collect()] == [("A", 3, 5, 3)]


def test_cc_tokens_are_counted_in_any_neighbourhood(files):
    body = "\tx = a&&b||c && elif_ || iff\n\tif(a){for{}}; éif := 1; switch x {case 1:}\n"
    facts = go_facts(files({"p/a.go": "package p\n\nfunc A() {\n" + body + "}\n"}))
    assert [r.complexity for r in facts["funcs"].collect()] == [1 + 4 + 3]


def test_signatures_move_as_lines(files):
    facts = go_facts(files({"p/a.go": "package p\n\nfunc A(a, b int,\n\tc string) {\n}\n"}))
    params = go_params(facts["lines"])
    plan = params._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("Generate")
    assert [(r.idx, r.name, r.type) for r in params.orderBy("idx").collect()] == [(0, "a", "int"), (1, "b", "int"), (2, "c", "string")]


def test_go_facts_move_no_lines(files):
    facts = go_facts(files({"p/a.go": "package p\n\ntype S struct{ a int }\n\nfunc A(a int) { x.Y() }\n"}), materialize=False)
    for name in ("packages", "imports", "funcs", "types", "fields", "params", "calls"):
        plan = facts[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan and "Join" not in plan, name


def _odd_go(rng):
    """Go text of pieces in any order, also broken ones."""
    pieces = ["package p\n", "import \"fmt\"\n", "import (\n\tx \"a/b\" // c\n\t. `d`\n\t_ \"e\" /* \"f\" */\n)\n", "func (r *T[K]) M(a, b int, c ...string) {\n",
              "func F(\n\ta map[string][]int,\n\tf func(x int) error, // )\n) (int, error) {\n", "}\n", "{\n", "(\n", ")\n", "\tfmt.Println(a.B (1), é.Ça(\"x.Y(\"))\n",
              "\tif a&&&b || c { for { } }\n", "type T struct {\n\ta, b int\n\t*q.T\n\tm map[string]struct{ x int }\n}\n", "type (\n\tA = B\n\tC[K any, V int] []V; D interface{ M() }\n)\n",
              "\ttype in struct{ a int; b *[4]in }\n", "\ts := `raw\n{ if`\n", "/* open { \n if */\n", "\tx := '\\'' + \"\\\"{\" + '{'\n", "// func N() {\n", "\"\n", "`\n", "\tcase1, ncase, caseé := 1\n",
              "func G() func(x struct{ a int }) { return nil }\n", "func (T) H(int, Gen[int], <-chan T) {}\n", "typed := 1\n", "functional()\n", "\r\n", "var v = struct{ a int }{1}\n", "/*/ x */\n"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))


def test_scanned_parameters_and_calls_are_those_of_the_lines(files):
    import random

    from srclens.operators.gofacts import go_calls, go_params
    rng = random.Random(3)
    facts = go_facts(files({f"p/f{i}.go": _odd_go(rng) for i in range(60)}))
    for scanned, lines in ((facts["params"], go_params(facts["lines"])), (facts["calls"], go_calls(facts["lines"]))):
        got, want = (sorted(map(repr, df.select(*sorted(lines.columns)).collect())) for df in (scanned, lines))
        assert got == want and len(want) > 20


def test_a_scan_of_go_files_is_the_same_in_any_pieces(monkeypatch):
    import random

    import pyarrow as pa

    from srclens.operators import filescan, goscan
    rng = random.Random(4)
    rows = [(i, "r", f"p{i % 5}/f{i:03d}.go", f"p{i % 5}", _odd_go(rng)) for i in range(40)]
    rows[7] = rows[7][:4] + ("",)
    rows.insert(9, rows[8])

    def found(chunk, size):
        monkeypatch.setattr(filescan, "CHUNK", chunk)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("fid", "repo", "path", "dir", "content"), r)) for r in rows[k:k + size]]) for k in range(0, len(rows), size)]
        return sorted(str(r) for b in goscan.scanner(True)(iter(batches)) for r in b.to_pylist())
    assert found(1 << 21, 100) == found(1, 1) == found(500, 3)


def test_fields_without_a_type_end_no_job(files):
    facts = go_facts(files({"p/a.go": "package p\n\ntype S struct {\n\ta, b\n\tc int\n}\n"}))
    assert [(r.name, r.fields) for r in facts["structs"].collect()] == [("S", 3)]
