"""Synthetic source corpora generated with Spark from the test tables.

The test tables hold no source code, so the corpora are written from them
with Spark expressions, and every fact an analyser should find is a plain
function of table columns. The oracles in ``plans.oracles`` compute those
facts from the tables directly (they never parse), which makes the check
independent of the analysers.

Python corpus, one file per customer ``k`` of nation ``n``::

    repo  r<n>            dir  r<n>/p<k div 8>       path  <dir>/c_<k>.py

     1  # customer <k>: if for while and or          comment, skipped
     2  import os
     3                                                blank, skipped
     4  class C_<k>:
     5      \"\"\"Customer <k> or nothing.\"\"\"          class body, outside functions
     6      def __init__(self, name):
     7          super().__init__()
        +       self.o_<orderkey> = None               one per order -> fields
        +       def _inner(v):                         k % 17 = 0: nested def, cc 2,
        +           return v and v                     class '' (no self); the next
        +       self.late = 1                          line belongs to no function
        per lineitem (orderkey, linenumber), q = int(l_quantity):
            def m_<orderkey>_<linenumber>(self, x):
                # if for while                        k % 3 = 0
                if x and x and x and x: pass           ceil(q/4) lines, q keywords
                y = 'éor'                              k % 7 = 0: one more keyword
                return x
                                                       k % 2 = 0: blank line
        def helper_<k>(x):                             k % 11 = 0: static, class ''
            return x or None                           cc 2
        async def fetch(self):                         k % 13 = 0: not a header; closes
            if x: pass                                 the open function; counted nowhere
    class C_<k>(Base):                                 k % 19 = 0: redefined class:
        def extra(self):                               methods 1, fields 0
            pass

Customers with ``k % 5 = 0`` indent with tabs (a tab counts four).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pyfacts import file_partitions
from .tables import table


def _repeated(items: str, times: str) -> Column:
    # A customer that is listed twice has each of its lines twice.
    return F.when(F.col(times) > 1, F.sort_array(F.flatten(F.array_repeat(items, F.col(times).cast("int"))))).otherwise(F.col(items))


def _py_method_text() -> str:
    # SQL expression for one method block, built per lineitem row.
    return """
    concat_ws('\n',
      concat(ind1, 'def m_', l_orderkey, '_', l_linenumber, '(self, x):'),
      CASE WHEN k % 3 = 0 THEN concat(ind2, '# if for while') END,
      array_join(transform(sequence(0, CAST(ceil(q / 4.0) AS INT) - 1),
                 j -> concat(ind2, 'if x', repeat(' and x', least(4, q - 4 * j) - 1), ': pass')), '\n'),
      CASE WHEN k % 7 = 0 THEN concat(ind2, "y = 'éor'") END,
      concat(ind2, 'return x'),
      CASE WHEN k % 2 = 0 THEN '' END)
    """


def python_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_files(repo, path, dir, lang, content) with one Python file per customer."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")

    ind = (cust
           .withColumn("ind1", F.expr("CASE WHEN k % 5 = 0 THEN '\t' ELSE '    ' END"))
           .withColumn("ind2", F.expr("concat(ind1, ind1)")))

    fields = (orders.groupBy("o_custkey")
              .agg(F.sort_array(F.collect_list("o_orderkey")).alias("okeys"))
              .withColumnRenamed("o_custkey", "k"))

    methods = (items.join(orders, items.l_orderkey == orders.o_orderkey)
               .join(ind.select("k", "ind1", "ind2"), F.col("o_custkey") == F.col("k"))
               .withColumn("q", F.col("l_quantity").cast("int"))
               .select("k", "l_orderkey", "l_linenumber", "q",
                       F.expr(_py_method_text()).alias("txt")))
    # A task's share of the texts must not grow with the tables: beyond the session's count it is an explicit one.
    # Small tables are dealt as the session does, which sets the order in which files without a path meet.
    parts = file_partitions(methods, per_core=0)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions", "200")):
        methods = methods.repartition(parts, "k")
    methods = (methods.groupBy("k")
               .agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "q", "txt")))
                    .alias("ms")))

    body = (ind.join(fields, "k", "left").join(methods, "k", "left")
            .select(
                "k", "n",
                F.expr("""
                concat_ws('\n',
                  concat('# customer ', k, ': if for while and or'),
                  'import os',
                  '',
                  concat('class C_', k, ':'),
                  concat(ind1, '\"\"\"Customer ', k, ' or nothing.\"\"\"'),
                  concat(ind1, 'def __init__(self, name):'),
                  concat(ind2, 'super().__init__()'),
                  nullif(array_join(transform(coalesce(okeys, array()),
                         o -> concat(ind2, 'self.o_', o, ' = None')), '\n'), ''),
                  CASE WHEN k % 17 = 0 THEN concat(ind2, 'def _inner(v):\n', ind2, ind1,
                       'return v and v\n', ind2, 'self.late = 1') END,
                  nullif(array_join(transform(coalesce(ms, array()), m -> m.txt), '\n'), ''),
                  CASE WHEN k % 11 = 0 THEN concat(ind1, 'def helper_', k, '(x):\n', ind2,
                       'return x or None') END,
                  CASE WHEN k % 13 = 0 THEN concat(ind1, 'async def fetch(self):\n', ind2,
                       'if x: pass') END,
                  CASE WHEN k % 19 = 0 THEN concat('class C_', k, '(Base):\n', ind1,
                       'def extra(self):\n', ind2, 'pass') END)
                """).alias("content")))
    return (body
            .withColumn("repo", F.concat(F.lit("r"), F.col("n")))
            .withColumn("dir", F.concat(F.col("repo"), F.lit("/p"), F.expr("k div 8")))
            .withColumn("path", F.concat(F.col("dir"), F.lit("/c_"), F.col("k"), F.lit(".py")))
            .withColumn("lang", F.lit("python"))
            .select("repo", "path", "dir", "lang", "content"))


#: A Python file of customer <k> with a signature over several lines.
PY_SHAPE = """class Client_<k>:
    def __init__(
        self, user_id: int,  # the (id
        user_email: dict[str, list[int]] = "a)b",
        *, home_url=None, x=(1, [2, 3]), **rest_opts
    ) -> None:
        self.a = [
            1]

    def other(self, a_id, b_id, c_id): pass

class Small_<k>:
    def __init__(self, a_id, b_code, c=f(d_id, e_id)): pass
"""


def py_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<n>/e<k>/shape.py`` (PY_SHAPE) for every customer with k % 4 = 1."""
    k = F.col("c_custkey").cast("string")
    repo = F.concat(F.lit("r"), F.col("c_nationkey"))
    folder = F.concat_ws("/", repo, F.concat(F.lit("e"), k))
    return table(spark, sf_dir, "customer").filter("c_custkey % 4 = 1").select(
        repo.alias("repo"), F.concat(folder, F.lit("/shape.py")).alias("path"), folder.alias("dir"), F.lit("python").alias("lang"),
        F.replace(F.lit(PY_SHAPE), F.lit("<k>"), k).alias("content"))


_GO_DECOYS = "\n".join([
    "\ts := \"if { && }\"",
    "\tr := '{'",
    "\tt := `case if {`",
    "\t// if && { for",
    "\t/* for { */",
])
_GO_SWITCH = "\n".join(["\tswitch x {", "\tcase 1:", "\tcase 2:", "\tdefault:", "\t}"])


#: Files of customer <k> with the shapes that the other Go files lack, by path below ``r<n>/e<k>/``.
GO_SHAPES = {
    "app.go": """package app

import (
\t"fmt"
\tst "example.com/org/e<k>/store"
\t// "not/imported"
)

type real_<k> struct {
\tdsn string
}

type MyDB real_<k>

type Deep MyDB

type Short = real_<k>

type Gen[K comparable, V any] struct {
\titem V
}

type Cases []struct {
\ta, b, c int
}

type Fixed [4]struct{ a int }

type Service struct {
\tcache   *st.PG
\trepo    st.Reader
\tdb      MyDB
\tstore   Deep
\tclient  *Gen[string, int]
\tqueue   [4]real_<k>
\tbus     Short
\tlogger  *log.Logger
\tOrderID, UserID string
\tClientEmail     string
\t*st.PG
\tGen[int, int]
}

func Évaluer(
\ta int,
\tcb func(x int) (int, error), opts ...string,
) (int, error) {
\ttype args struct {
\t\tp, q int
\t}
\téif := a
""" + "".join(f"\tfmt.A{i}(a)\n" for i in range(1, 12)) + """\tfmt.A1(éif)
\treturn cb(a)
}

func (s *Service) Run(m map[string][]int, g Gen[string, int]) error {
\ttype args struct {
\t\tonly int
\t}
\tif s.db != nil && m != nil {
\t\treturn s.cache.Close()
\t}
\treturn st.Open(m)
}
""",
    "store/pg.go": """package store

type PG struct {
\tID int
}

type Reader interface {
\tRead() int
}

func Open(m map[string][]int) error { return nil }
""",
    "gen/g.go": "package gen\n\ntype Made_<k> struct{ x int }\n",
    "made.go": "// Code generated by maker. DO NOT EDIT.\n\npackage app\n\ntype Written struct{ y int }\n",
    "app_test.go": "package app\n\ntype Big struct {\n" + "".join(f"\tf{i} int\n" for i in range(12)) + "}\n\nfunc TestBig() {\n\tx := 1\n}\n",
}


def go_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of GO_SHAPES for every customer with k % 4 = 1: import aliases
    and qualified fields, chains of defined types, aliases, generics, slices and
    arrays of structs, local types of one name, names beyond ASCII, signatures
    over several lines, repeated and more than ten calls, domain names, test
    files and generated files."""
    cust = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 1").select(
        F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit("r"), F.col("c_nationkey")).alias("repo"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in GO_SHAPES.items()]))
    f = cust.select("repo", "k", each.alias("f"))
    path = F.concat_ws("/", "repo", F.concat(F.lit("e"), F.col("k")), F.col("f.name"))
    return f.select("repo", path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.lit("go").alias("lang"),
                    F.replace(F.col("f.text"), F.lit("<k>"), F.col("k")).alias("content"))


def go_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_files with one Go struct file per customer and one method file
    per (customer, order status); all files of a customer share the package
    directory ``r<n>/g<k div 8>``.

    Struct file ``c_<k>.go``::

         1  package g<k div 8>
         3  // Cust_<k> keeps "quoted { braces" and if for case words.
         4  type Store_<k> struct {   (k even)  |  type Store_<k> interface {  (k odd)
         5      id int                          |      Get() int
         8  type Cust_<k> struct {
         9      db *Store_<k>                   concrete dependency iff k even
                F_<orderkey> int                one per order
                Base                            k % 3 = 0, embedded
                a, b int                        k % 4 = 0
                cache, x *Cache_<k>             k % 5 = 0, undeclared type: syntactic rule
                logger *log.Logger              k % 5 = 0, qualified: not concrete
            }
            func New_<k>() *Cust_<k> { return nil }

    Method file ``c_<k>_<status>.go``: one method per lineitem of the
    customer's orders with that status, receiver ``*Cust_<k>`` (value
    receiver when k % 7 = 0); body: decoy literals and comments (k % 4 = 0),
    ceil(q/5) lines ``if x > 0 && y > 0 ... { x++ }`` with q keywords, a
    switch with two cases and a default (k % 5 = 0), a function literal with
    ``||`` (k % 6 = 0), ``return helper.Sum(x, y)`` (one call target).

    See ``go_shapes`` for the other files.
    """
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    dirs = (cust.withColumn("repo", F.concat(F.lit("r"), F.col("n")))
            .withColumn("dir", F.concat(F.col("repo"), F.lit("/g"), F.expr("k div 8")))
            .withColumn("pkgline", F.concat(F.lit("package g"), F.expr("k div 8"))))

    fields = (orders.groupBy(F.col("o_custkey").alias("k"))
              .agg(F.sort_array(F.collect_list("o_orderkey")).alias("okeys")))
    struct_files = (dirs.join(fields, "k", "left").select(
        "repo", "dir", F.concat(F.col("dir"), F.lit("/c_"), F.col("k"), F.lit(".go")).alias("path"),
        F.expr(r"""
        concat_ws('\n',
          pkgline, '',
          concat('// Cust_', k, ' keeps "quoted { braces" and if for case words.'),
          CASE WHEN k % 2 = 0 THEN concat('type Store_', k, ' struct {\n\tid int\n}')
               ELSE concat('type Store_', k, ' interface {\n\tGet() int\n}') END,
          '',
          concat('type Cust_', k, ' struct {'),
          concat('\tdb *Store_', k),
          nullif(array_join(transform(coalesce(okeys, array()), o -> concat('\tF_', o, ' int')), '\n'), ''),
          CASE WHEN k % 3 = 0 THEN '\tBase' END,
          CASE WHEN k % 4 = 0 THEN '\ta, b int' END,
          CASE WHEN k % 5 = 0 THEN concat('\tcache, x *Cache_', k, '\n\tlogger *log.Logger') END,
          '}',
          '',
          concat('func New_', k, '() *Cust_', k, ' { return nil }'),
          '')
        """).alias("content")))

    decoys = _GO_DECOYS.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    switch = _GO_SWITCH.replace("\n", "\\n").replace("\t", "\\t")
    method = f"""
    concat_ws('\\n',
      concat('func (c ', CASE WHEN k % 7 = 0 THEN '' ELSE '*' END, 'Cust_', k, ') M_', m.l_orderkey, '_',
             m.l_linenumber, '(x int, y int) int {{'),
      CASE WHEN k % 4 = 0 THEN '{decoys}' END,
      array_join(transform(sequence(0, CAST(ceil(m.q / 5.0) AS INT) - 1),
                 j -> concat('\\tif x > 0', repeat(' && y > 0', least(5, m.q - 5 * j) - 1), ' {{ x++ }}')), '\\n'),
      CASE WHEN k % 5 = 0 THEN '{switch}' END,
      CASE WHEN k % 6 = 0 THEN '\\tf := func() bool {{ return x > 0 || y > 0 }}' END,
      '\\treturn helper.Sum(x, y)',
      '}}',
      '')
    """
    # Only numbers move; the text is written where a file's lines are together.
    lists = (items.join(orders, items.l_orderkey == orders.o_orderkey)
             .groupBy(F.col("o_custkey").alias("k"), "o_orderstatus")
             .agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
                  .alias("ms")))
    folders = dirs.groupBy("k", "repo", "dir", "pkgline").agg(F.count("*").alias("times"))
    method_files = (lists.join(folders, "k").withColumn("ms", _repeated("ms", "times"))
                    .select("repo", "dir",
                            F.concat(F.col("dir"), F.lit("/c_"), F.col("k"), F.lit("_"),
                                     F.lower("o_orderstatus"), F.lit(".go")).alias("path"),
                            F.concat_ws("\n", F.col("pkgline"), F.lit(""),
                                        F.expr(f"array_join(transform(ms, m -> {method}), '\\n')"))
                            .alias("content")))
    return (struct_files.unionByName(method_files)
            .withColumn("lang", F.lit("go"))
            .select("repo", "path", "dir", "lang", "content")
            .unionByName(go_shapes(spark, sf_dir)))


def enrichment_responses(findings: DataFrame) -> DataFrame:
    """Raw model answers for each finding, derived from the finding itself.

    line % 5 = 0: JSON object inside a fenced block with prose around it
               1: bare object with an empty effort (the finding keeps its own)
               2: no JSON at all (finding unchanged)
               3: a number where a string is expected (rejected, unchanged)
               4: object with prose around it and only two fields
    """
    from ..operators.enrich import finding_id
    raw = F.expr("""
      CASE line % 5
        WHEN 0 THEN concat('Sure, here it is:\n```json\n{"explanation":"', component,
                           ' is too big","refactor_before":"type A struct{}","refactor_after":"type A interface{}","effort":"Moyen"}\n```')
        WHEN 1 THEN concat('{"explanation":"', component, ' mixes concerns","refactor_before":"a","refactor_after":"b","effort":""}')
        WHEN 2 THEN 'I cannot answer that.'
        WHEN 3 THEN '{"explanation": 42, "effort": "Élevé"}'
        ELSE concat('Answer: {"explanation":"', component, ' ok","effort":"Faible"} -- end')
      END""")
    return findings.select(finding_id(findings).alias("finding_id"), raw.alias("raw"))


def stub_enricher(prompts):
    """A model for the inference queries: it answers a finding's prompt by its line number.

    line % 1999 = 6 in a file c_1*: no answer before the time limit; line % 10 = 3: an error;
    else one JSON object, inside prose where the line is even."""
    import re
    import time

    def answer(prompt: str) -> str:
        line = int(re.search(r"Location         : .*:(\d+)\n", prompt).group(1))
        if line % 1999 == 6 and "/c_1" in prompt:
            time.sleep(3600)
        if line % 10 == 3:
            raise ValueError("refused")
        body = f'{{"explanation":"line {line}","effort":"Moyen"}}'
        return f"Here: {body} done" if line % 2 == 0 else body
    return prompts.map(answer)


def stub_package_analyser(prompts):
    """A model for package prompts: the number n at the end of the directory decides.

    n = 49: no answer before the time limit; n % 7 = 3: an error; else two
    findings in prose, one of them with a file of its own."""
    import re
    import time

    def answer(prompt: str) -> str:
        where, n = re.search(r"package at: (\S*?(\d+))\n", prompt).groups()
        if n == "49":
            time.sleep(3600)
        if int(n) % 7 == 3:
            raise ValueError("refused")
        return (f'Smells: [{{"smell_type":"feature_envy","component":"P{n}","line":{int(n) + 1},"severity":"moyen"}}, '
                f'{{"smell_type":"layer_violation","file":"{where}/x.py","effort":"Élevé"}}]')
    return prompts.map(answer)


def deep_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deep-analysis answer per event: prose around a JSON array of two
    elements whose values come from the event. Broken on purpose:
    event_id % 11 = 0 puts a string where the line number goes (the whole
    array is rejected); event_id % 13 = 0 loses the closing bracket."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    e1 = """concat('{"smell_type":"', event_type, '","component":"U', user_id, '.', event_type,
         '","line":', event_id % 500, ',"severity":"',
         CASE event_type WHEN 'click' THEN 'critique' WHEN 'error' THEN 'Moyen' WHEN 'purchase' THEN 'FAIBLE'
              WHEN 'signup' THEN 'high' ELSE 'CRITIQUE' END,
         '","pattern":"Observer","effort":"',
         CASE event_type WHEN 'click' THEN 'Élevé' WHEN 'error' THEN 'moyen' WHEN 'purchase' THEN 'Moyen'
              ELSE 'Faible' END,
         '","explanation":"event ', event_id, '"}')"""
    e2 = """concat('{"smell_type":"feature_envy","file":"pkg/f', event_id, '.go","line":',
         CASE WHEN event_id % 11 = 0 THEN '"12"' ELSE CAST(event_id % 97 AS STRING) END, '}')"""
    raw = F.expr(f"""concat('Here are the smells:\n[', {e1}, ',\n ', {e2},
                     CASE WHEN event_id % 13 = 0 THEN '' ELSE ']' END, '\nHope this helps.')""")
    return ev.select("event_id", F.concat(F.lit("r"), F.col("user_id") % 25).alias("repo"),
                     F.concat(F.lit("pkg/u"), F.col("user_id"), F.lit(".go")).alias("default_file"),
                     raw.alias("raw"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative source paths built from ``part``: repo r<partkey % 25>, a
    directory chosen by ``partkey % 8`` (some of them excluded by the
    walkers) and a file named after the part type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    seg = F.expr("""element_at(array('venv', 'pkg.egg-info', '__pycache__', 'build', 'src', 'lib/.tox',
                                     'app/core', 'vendor'), CAST(p_partkey % 8 AS INT) + 1)""")
    name = F.lower(F.regexp_replace("p_type", " ", "_"))
    return p.select(F.concat(F.lit("r"), F.col("p_partkey") % 25).alias("repo"), "p_partkey",
                    F.concat(seg, F.lit("/"), name).alias("stem"))
