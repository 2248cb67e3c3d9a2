"""DuckDB oracles: expected facts computed straight from the test tables.

None of these parse source text: they restate, as arithmetic over the
tables, what ``sources.testcorpus`` wrote into each generated file. The
only oracles that read text are those over ``documents``, where DuckDB's
RE2 engine gives the analysed tool's own regex semantics.
"""

# RE2 forms of the fixed patterns (see functions.patterns).
_GO_SPACE = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_CC = r"\b(?:if|elif|for|while|except|and|or)\b"

# Python corpus: per-customer layout (see sources.testcorpus).
PY_BASE = """
c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
oc AS (SELECT o_custkey AS k, count(*) AS n_o FROM orders GROUP BY 1),
li AS (SELECT o.o_custkey AS k, l.l_orderkey, l.l_linenumber, CAST(l.l_quantity AS INTEGER) AS q
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
m AS (SELECT k, l_orderkey, l_linenumber, q,
             CAST(ceil(q / 4.0) AS INTEGER) AS nif,
             1 + CAST(k % 3 = 0 AS INTEGER) + CAST(ceil(q / 4.0) AS INTEGER)
               + CAST(k % 7 = 0 AS INTEGER) + 1 + CAST(k % 2 = 0 AS INTEGER) AS sz
      FROM li),
base AS (SELECT c.k, c.n, coalesce(oc.n_o, 0) AS n_o,
                7 + coalesce(oc.n_o, 0) + CASE WHEN c.k % 17 = 0 THEN 3 ELSE 0 END AS h,
                'r' || c.n AS repo,
                'r' || c.n || '/p' || (c.k // 8) || '/c_' || c.k || '.py' AS path
         FROM c LEFT JOIN oc USING (k)),
ml AS (SELECT m.*, base.h + 1 + coalesce(sum(sz) OVER (PARTITION BY m.k ORDER BY l_orderkey, l_linenumber, q
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
       FROM m JOIN base USING (k)),
tot AS (SELECT k, sum(sz) AS s, count(*) AS n_li FROM m GROUP BY k),
ends AS (SELECT base.*, base.h + coalesce(tot.s, 0) AS e, coalesce(tot.n_li, 0) AS n_li
         FROM base LEFT JOIN tot USING (k)),
pyfuncs AS (
  SELECT k, 'm_' || l_orderkey || '_' || l_linenumber AS name, CAST(line AS INTEGER) AS line,
         'C_' || k AS class, 1 + q + CAST(k % 7 = 0 AS INTEGER) AS complexity FROM ml
  UNION ALL SELECT k, '__init__', 6, 'C_' || k, 1 FROM base
  UNION ALL SELECT k, '_inner', 8 + n_o, '', 2 FROM base WHERE k % 17 = 0
  UNION ALL SELECT k, 'helper_' || k, e + 1, '', 2 FROM ends WHERE k % 11 = 0
  UNION ALL SELECT k, 'extra', e + 2 + 2 * CAST(k % 11 = 0 AS INTEGER) + 2 * CAST(k % 13 = 0 AS INTEGER),
            'C_' || k, 1 FROM ends WHERE k % 19 = 0),
pyclasses AS (
  SELECT k, 'C_' || k AS name, 4 AS line, 1 + n_li AS methods, n_o AS fields FROM ends
  UNION ALL SELECT k, 'C_' || k, e + 1 + 2 * CAST(k % 11 = 0 AS INTEGER) + 2 * CAST(k % 13 = 0 AS INTEGER),
            1, 0 FROM ends WHERE k % 19 = 0)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


PY_FUNCS = _with(PY_BASE) + """
SELECT b.repo, b.path, f.name, CAST(f.line AS INTEGER) AS line, f.class,
       CAST(f.complexity AS INTEGER) AS complexity
FROM pyfuncs f JOIN base b USING (k)
"""

PY_CLASSES = _with(PY_BASE) + """
SELECT b.repo, b.path, p.name, CAST(p.line AS INTEGER) AS line,
       CAST(p.methods AS INTEGER) AS methods, CAST(p.fields AS INTEGER) AS fields
FROM pyclasses p JOIN base b USING (k)
"""

PY_LINES_INDENT = _with(PY_BASE) + """
, per_file AS (
  SELECT b.repo, b.k,
         5 + b.n_o + 3 * CAST(b.k % 17 = 0 AS INTEGER)
           + coalesce(sum(2 + m.nif + CAST(b.k % 7 = 0 AS INTEGER)), 0)
           + 2 * CAST(b.k % 11 = 0 AS INTEGER) + 2 * CAST(b.k % 13 = 0 AS INTEGER)
           + 3 * CAST(b.k % 19 = 0 AS INTEGER) AS code_lines,
         16 + 8 * b.n_o + 28 * CAST(b.k % 17 = 0 AS INTEGER)
           + coalesce(sum(4 + 8 * (1 + m.nif + CAST(b.k % 7 = 0 AS INTEGER))), 0)
           + 12 * CAST(b.k % 11 = 0 AS INTEGER) + 12 * CAST(b.k % 13 = 0 AS INTEGER)
           + 12 * CAST(b.k % 19 = 0 AS INTEGER) AS indent_sum
  FROM base b LEFT JOIN m USING (k) GROUP BY b.repo, b.k, b.n_o)
SELECT repo, CAST(count(*) AS BIGINT) AS files, CAST(sum(code_lines) AS BIGINT) AS code_lines,
       CAST(sum(indent_sum) AS BIGINT) AS indent_sum
FROM per_file GROUP BY repo
"""


def _cc_sev(col: str) -> str:
    return (f"CASE WHEN {col} > 20 THEN 'CRITIQUE' WHEN {col} > 15 THEN 'MOYEN' ELSE 'FAIBLE' END")


def _cc_eff(col: str) -> str:
    return (f"CASE WHEN {col} > 20 THEN 'Élevé' WHEN {col} > 15 THEN 'Moyen' ELSE 'Faible' END")


PY_HIGH_COMPLEXITY_ROWS = """
SELECT b.repo, {sev} AS severity, 'high_complexity' AS smell_type, b.path AS file,
       CAST(f.line AS INTEGER) AS line,
       CASE WHEN f.class <> '' THEN f.class || '.' || f.name ELSE f.name END AS component,
       'cc=' || f.complexity AS metrics, 'Stratégie' AS pattern, {eff} AS effort
FROM pyfuncs f JOIN base b USING (k) WHERE f.complexity > 10
""".format(sev=_cc_sev("f.complexity"), eff=_cc_eff("f.complexity"))

PY_GOD_CLASS_ROWS = """
SELECT b.repo,
       CASE WHEN p.methods > 30 OR p.fields > 20 THEN 'CRITIQUE' ELSE 'MOYEN' END AS severity,
       'god_class' AS smell_type, b.path AS file, CAST(p.line AS INTEGER) AS line, p.name AS component,
       'fields=' || p.fields || ', methods=' || p.methods AS metrics, 'Façade' AS pattern,
       CASE WHEN p.methods > 30 OR p.fields > 20 THEN 'Élevé' ELSE 'Moyen' END AS effort
FROM pyclasses p JOIN base b USING (k) WHERE p.methods > 15 OR p.fields > 10
"""

PY_HIGH_COMPLEXITY = _with(PY_BASE) + PY_HIGH_COMPLEXITY_ROWS
PY_GOD_CLASS = _with(PY_BASE) + PY_GOD_CLASS_ROWS

DOC_LINES = f"""
doc_lines AS (
  SELECT doc_id, source,
         regexp_replace(l, '^{_GO_SPACE}+|{_GO_SPACE}+$', '', 'g') AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents))
"""

PY_DOC_BRANCH_KEYWORDS = _with(DOC_LINES) + f"""
SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs,
       CAST(count(*) AS BIGINT) AS code_lines,
       CAST(sum(len(regexp_extract_all(t, '{_CC}'))) AS BIGINT) AS keywords
FROM doc_lines WHERE t <> '' AND NOT starts_with(t, '#')
GROUP BY source
"""

# Go corpus: per-customer layout (see sources.testcorpus.go_corpus).
GO_BASE = """
gc AS (SELECT c_custkey AS k, 'r' || c_nationkey AS repo,
              'r' || c_nationkey || '/g' || (c_custkey // 8) AS dir FROM customer),
goc AS (SELECT o_custkey AS k, count(*) AS n_o FROM orders GROUP BY 1),
gli AS (SELECT o.o_custkey AS k, lower(o.o_orderstatus) AS st, l.l_orderkey, l.l_linenumber,
               CAST(l.l_quantity AS INTEGER) AS q
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
gcnt AS (SELECT k, count(*) AS n_li FROM gli GROUP BY k),
gm AS (SELECT gli.*, 1 + 5 * CAST(k % 4 = 0 AS INTEGER) + CAST(ceil(q / 5.0) AS INTEGER)
                     + 5 * CAST(k % 5 = 0 AS INTEGER) + CAST(k % 6 = 0 AS INTEGER) + 3 AS sz FROM gli),
gml AS (SELECT gm.*, 3 + coalesce(sum(sz) OVER (PARTITION BY k, st ORDER BY l_orderkey, l_linenumber, q
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM gm),
gbase AS (SELECT gc.*, coalesce(goc.n_o, 0) AS n_o, coalesce(gcnt.n_li, 0) AS n_li,
                 1 + coalesce(goc.n_o, 0) + CAST(gc.k % 3 = 0 AS INTEGER) + 2 * CAST(gc.k % 4 = 0 AS INTEGER)
                   + 3 * CAST(gc.k % 5 = 0 AS INTEGER) AS nf,
                 gc.dir || '/c_' || gc.k || '.go' AS spath
          FROM gc LEFT JOIN goc USING (k) LEFT JOIN gcnt USING (k)),
gext AS (SELECT c_custkey AS k, 'r' || c_nationkey AS repo, 'r' || c_nationkey || '/e' || c_custkey AS dir
         FROM customer WHERE c_custkey % 4 = 1),
gofuncs AS (
  SELECT repo, dir AS pkg, dir || '/app.go' AS path, 'Évaluer' AS name, NULL AS recv, NULL AS recv_cc, 44 AS line,
         22 AS lines, 1 AS complexity FROM gext
  UNION ALL SELECT repo, dir, dir || '/app.go', 'Run', 'Service', 'Service', 67, 9, 3 FROM gext
  UNION ALL SELECT repo, dir || '/store', dir || '/store/pg.go', 'Open', NULL, NULL, 11, 1, 1 FROM gext
  UNION ALL
  SELECT b.repo, b.dir AS pkg, b.dir || '/c_' || m.k || '_' || m.st || '.go' AS path,
         'M_' || m.l_orderkey || '_' || m.l_linenumber AS name, 'Cust_' || m.k AS recv,
         'Cust_' || m.k AS recv_cc, CAST(m.line AS INTEGER) AS line, CAST(m.sz - 1 AS INTEGER) AS lines,
         CAST(1 + m.q + 2 * CAST(m.k % 5 = 0 AS INTEGER) + CAST(m.k % 6 = 0 AS INTEGER) AS INTEGER) AS complexity
  FROM gml m JOIN gbase b USING (k)
  UNION ALL
  SELECT repo, dir, spath, 'New_' || k, NULL, NULL,
         CAST(12 + n_o + CAST(k % 3 = 0 AS INTEGER) + CAST(k % 4 = 0 AS INTEGER)
              + 2 * CAST(k % 5 = 0 AS INTEGER) AS INTEGER), 1, 1
  FROM gbase),
gostructs AS (
  SELECT repo, dir AS pkg, spath AS path, 'Cust_' || k AS name, 8 AS line,
         CAST(nf AS INTEGER) AS fields, CAST(n_li AS INTEGER) AS methods FROM gbase
  UNION ALL
  SELECT repo, dir, spath, 'Store_' || k, 4, 1, 0 FROM gbase WHERE k % 2 = 0
  UNION ALL SELECT repo, dir, dir || '/app.go', 'real_' || k, 9, 1, 0 FROM gext
  UNION ALL SELECT repo, dir, dir || '/app.go', 'Gen', 19, 1, 0 FROM gext
  UNION ALL SELECT repo, dir, dir || '/app.go', 'Service', 29, 13, 1 FROM gext
  UNION ALL SELECT repo, dir, dir || '/app.go', 'args', 68, 1, 0 FROM gext
  UNION ALL SELECT repo, dir, dir || '/made.go', 'Written', 5, 1, 0 FROM gext
  UNION ALL SELECT repo, dir || '/gen', dir || '/gen/g.go', 'Made_' || k, 3, 1, 0 FROM gext
  UNION ALL SELECT repo, dir || '/store', dir || '/store/pg.go', 'PG', 3, 1, 0 FROM gext)
"""

GO_FUNCS = _with(GO_BASE) + "SELECT * FROM gofuncs"
GO_STRUCTS = _with(GO_BASE) + "SELECT * FROM gostructs"

GO_HIGH_COMPLEXITY_ROWS = """
SELECT repo, {sev} AS severity, 'high_complexity' AS smell_type, path AS file, line,
       CASE WHEN coalesce(recv_cc, '') <> '' THEN recv_cc || '.' || name ELSE name END AS component,
       'cc=' || complexity AS metrics, 'Stratégie' AS pattern, {eff} AS effort
FROM gofuncs WHERE complexity > 10
""".format(sev=_cc_sev("complexity"), eff=_cc_eff("complexity"))

GO_GOD_STRUCT_ROWS = """
SELECT repo, CASE WHEN fields > 20 OR methods > 30 THEN 'CRITIQUE' ELSE 'MOYEN' END AS severity,
       'god_struct' AS smell_type, path AS file, line, name AS component,
       'fields=' || fields || ', methods=' || methods AS metrics, 'Façade' AS pattern,
       CASE WHEN fields > 20 OR methods > 30 THEN 'Élevé' ELSE 'Moyen' END AS effort
FROM gostructs WHERE fields > 10 OR methods > 15
"""

GO_CONCRETE_DEP_ROWS = """
SELECT repo, 'MOYEN' AS severity, 'concrete_dep' AS smell_type, spath AS file, 9 AS line,
       'Cust_' || k || '.db' AS component, '' AS metrics, 'Injection de dépendances' AS pattern,
       'Faible' AS effort
FROM gbase WHERE k % 2 = 0
UNION ALL
SELECT repo, 'MOYEN', 'concrete_dep', spath,
       CAST(10 + n_o + CAST(k % 3 = 0 AS INTEGER) + CAST(k % 4 = 0 AS INTEGER) AS INTEGER),
       'Cust_' || k || '.cache', '', 'Injection de dépendances', 'Faible'
FROM gbase WHERE k % 5 = 0
UNION ALL
SELECT repo, 'MOYEN', 'concrete_dep', dir || '/app.go', f.line, 'Service.' || f.name, '', 'Injection de dépendances', 'Faible'
FROM gext CROSS JOIN (VALUES (30, 'cache'), (32, 'db'), (33, 'store'), (34, 'client')) f(line, name)
"""

GO_HIGH_COMPLEXITY = _with(GO_BASE) + GO_HIGH_COMPLEXITY_ROWS
GO_GOD_STRUCT = _with(GO_BASE) + GO_GOD_STRUCT_ROWS
GO_CONCRETE_DEP = _with(GO_BASE) + GO_CONCRETE_DEP_ROWS

# All findings of both corpora (D6 / O4: UNION ALL).
ALL_FINDINGS = _with(PY_BASE, GO_BASE, "allf AS (" + "\nUNION ALL\n".join([
    PY_GOD_CLASS_ROWS, PY_HIGH_COMPLEXITY_ROWS, GO_GOD_STRUCT_ROWS, GO_CONCRETE_DEP_ROWS,
    GO_HIGH_COMPLEXITY_ROWS]) + ")",
    "repos AS (SELECT DISTINCT 'r' || c_nationkey AS repo FROM customer)")

FINDINGS_ALL = ALL_FINDINGS + "\nSELECT * FROM allf"

_SCORE = """
scores AS (
  SELECT r.repo, CAST(greatest(0, 100 - coalesce(sum(CASE f.severity WHEN 'CRITIQUE' THEN 15
             WHEN 'MOYEN' THEN 7 WHEN 'FAIBLE' THEN 3 ELSE 0 END), 0)) AS INTEGER) AS score
  FROM repos r LEFT JOIN allf f USING (repo) GROUP BY r.repo)
"""

REPO_SCORE = ALL_FINDINGS + ",\n" + _SCORE.strip() + "\nSELECT * FROM scores"

SEVERITY_COUNTS = ALL_FINDINGS + """
SELECT r.repo,
       CAST(count(*) FILTER (WHERE f.severity = 'CRITIQUE') AS BIGINT) AS critique,
       CAST(count(*) FILTER (WHERE f.severity = 'MOYEN') AS BIGINT) AS moyen,
       CAST(count(*) FILTER (WHERE f.severity = 'FAIBLE') AS BIGINT) AS faible,
       '' AS other
FROM repos r LEFT JOIN allf f USING (repo) GROUP BY r.repo
"""

QUALITY_GATE_MIN = 50

QUALITY_GATE = ALL_FINDINGS + ",\n" + _SCORE.strip() + f"""
SELECT repo, score, ({QUALITY_GATE_MIN} > 0 AND score < {QUALITY_GATE_MIN}) AS failed FROM scores
"""

SCORE_BAND = ALL_FINDINGS + ",\n" + _SCORE.strip() + """
SELECT repo, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'warn' ELSE 'bad' END AS band
FROM scores
"""

_FIELDS = r"CAST(regexp_extract(metrics, 'fields=(\d+)', 1) AS INTEGER)"
_METHODS = r"CAST(regexp_extract(metrics, 'methods=(\d+)', 1) AS INTEGER)"
_CCV = r"CAST(regexp_extract(metrics, 'cc=(\d+)', 1) AS INTEGER)"
_RANK = "CASE severity WHEN 'CRITIQUE' THEN 0 WHEN 'MOYEN' THEN 1 ELSE 2 END"
_METRICS_JSON = f"""CASE WHEN smell_type IN ('god_struct', 'god_class')
       THEN '{{"fields":' || {_FIELDS} || ',"methods":' || {_METHODS} || '}}'
       WHEN smell_type = 'high_complexity' THEN '{{"cc":' || {_CCV} || '}}' ELSE '{{}}' END"""

REPORT_JSON = ALL_FINDINGS + ",\n" + _SCORE.strip() + f"""
SELECT repo, -1 AS rank, '' AS file, 0 AS line, '' AS smell_type, '' AS component,
       '{{"dir":"' || repo || '","score":' || score || '}}' AS json
FROM scores
UNION ALL
SELECT repo, {_RANK}, file, line, smell_type, component,
       '{{"severity":"' || severity || '","smell_type":"' || smell_type || '","file":"' || file
       || '","line":' || line || ',"component":"' || component || '","metrics":' || {_METRICS_JSON}
       || ',"pattern":"' || pattern || '","effort":"' || effort || '"}}'
FROM allf
"""

_DESCRIBE = f"""CASE smell_type
  WHEN 'god_struct' THEN component || ' · ' || {_FIELDS} || ' champs · ' || {_METHODS} || ' méthodes'
  WHEN 'concrete_dep' THEN component || ' est un type concret, pas une interface'
  WHEN 'high_complexity' THEN component || ' · CC=' || {_CCV}
  ELSE component END"""

REPORT_TEXT = ALL_FINDINGS + ",\n" + _SCORE.strip() + f""",
counts AS (
  SELECT r.repo, count(*) FILTER (WHERE f.severity = 'CRITIQUE') AS c,
         count(*) FILTER (WHERE f.severity = 'MOYEN') AS m, count(*) FILTER (WHERE f.severity = 'FAIBLE') AS fa
  FROM repos r LEFT JOIN allf f USING (repo) GROUP BY r.repo)
SELECT repo, {_RANK} AS rank, file, line, smell_type, component,
       printf('%-22s %-20s %s', '[' || severity || ']', smell_type, file || ':' || line) || chr(10)
       || '             ' || {_DESCRIBE} || chr(10)
       || '             → Patron suggéré : ' || pattern || ' · Effort : ' || effort || chr(10) AS text
FROM allf
UNION ALL
SELECT s.repo, 3, '', 0, '', '',
       'score de maintenabilité : ' || s.score || ' / 100' || chr(10) || '  critique : ' || c.c
       || '  moyen : ' || c.m || '  faible : ' || c.fa
FROM scores s JOIN counts c USING (repo)
"""


def _esc(col: str) -> str:
    out = f"replace({col}, '&', '&amp;')"
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;"), ("+", "&#43;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


REPORT_HTML_ROWS = ALL_FINDINGS + ",\n" + _SCORE.strip() + f"""
SELECT repo, -1 AS rank, '' AS file, 0 AS line, '' AS smell_type, '' AS component,
       '<div class="score ' || CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'warn' ELSE 'bad' END
       || '">Score de maintenabilité : ' || score || ' / 100</div>' AS html
FROM scores
UNION ALL
SELECT repo, {_RANK}, file, line, smell_type, component,
       '<tr><td class="' || {_esc('severity')} || '">' || {_esc('severity')} || '</td><td>'
       || {_esc('smell_type')} || '</td><td><code>' || {_esc("file || ':' || line")} || '</code></td><td>'
       || {_esc('component')} || '</td><td>' || {_esc('pattern')} || '</td><td>' || {_esc('effort')}
       || '</td></tr>'
FROM allf
"""

# ---------------------------------------------------------------- enrichment
_PY_FINDINGS = _with(PY_BASE, "pyf AS (" + PY_GOD_CLASS_ROWS + "\nUNION ALL\n" + PY_HIGH_COMPLEXITY_ROWS + ")")
_FID = "repo || '|' || file || ':' || line || '|' || smell_type || '|' || component"

ENRICH_PROMPTS = _PY_FINDINGS + f"""
SELECT {_FID} AS finding_id,
  'You are a software architect expert in Go design patterns.' || chr(10)
  || 'A static analysis tool detected an architectural smell:' || chr(10) || chr(10)
  || 'Smell type       : ' || smell_type || chr(10)
  || 'Component        : ' || component || chr(10)
  || 'Location         : ' || file || ':' || line || chr(10)
  || CASE WHEN metrics <> '' THEN 'Metrics          : ' || metrics || chr(10) ELSE '' END
  || 'Suggested pattern: ' || pattern || chr(10) || chr(10)
  || 'CRITICAL: Output ONLY a raw JSON object — no markdown, no prose, no code fences.' || chr(10)
  || 'Your response must start with {{ and end with }}.' || chr(10) || chr(10)
  || '{{"explanation":"1-2 sentence diagnosis","refactor_before":"Go code ≤15 lines","refactor_after":"Go code ≤15 lines","effort":"Faible|Moyen|Élevé"}}'
  AS prompt
FROM pyf
"""

_ENRICHED = """
enr AS (
  SELECT pyf.*,
    CASE line % 5 WHEN 0 THEN component || ' is too big' WHEN 1 THEN component || ' mixes concerns'
                  WHEN 4 THEN component || ' ok' END AS explanation,
    CASE line % 5 WHEN 0 THEN 'type A struct{}' WHEN 1 THEN 'a' WHEN 4 THEN '' END AS refactor_before,
    CASE line % 5 WHEN 0 THEN 'type A interface{}' WHEN 1 THEN 'b' WHEN 4 THEN '' END AS refactor_after,
    CASE line % 5 WHEN 0 THEN 'Moyen' WHEN 4 THEN 'Faible' ELSE effort END AS new_effort
  FROM pyf)
"""

PARSE_ENRICHMENT = _PY_FINDINGS + ",\n" + _ENRICHED.strip() + f"""
SELECT {_FID} AS finding_id, explanation,
       CASE WHEN line % 5 = 4 THEN NULL ELSE refactor_before END AS refactor_before,
       CASE WHEN line % 5 = 4 THEN NULL ELSE refactor_after END AS refactor_after,
       CASE line % 5 WHEN 0 THEN 'Moyen' WHEN 1 THEN '' ELSE 'Faible' END AS effort
FROM enr WHERE line % 5 IN (0, 1, 4)
"""

PARSE_ENRICHMENT_BODY = _PY_FINDINGS + f"""
SELECT {_FID} AS finding_id, component || ' mixes concerns' AS explanation, 'a' AS refactor_before,
       'b' AS refactor_after, '' AS effort
FROM pyf WHERE line % 5 = 1
"""

INFER_ENRICHMENT = _PY_FINDINGS + f""",
st AS (SELECT *, line % 1999 = 6 AND file LIKE '%/c_1%' AS hangs, line % 10 = 3 AS fails,
              '{{"explanation":"line ' || line || '","effort":"Moyen"}}' AS body FROM pyf)
SELECT {_FID} AS finding_id,
       CASE WHEN hangs OR fails THEN NULL WHEN line % 2 = 0 THEN 'Here: ' || body || ' done' ELSE body END AS raw,
       CASE WHEN hangs THEN 'no answer in 1 s' WHEN fails THEN 'ValueError: refused' END AS error
FROM st
"""

INFER_PACKAGES = """
WITH p AS (SELECT DISTINCT 'r' || c_nationkey AS repo, c_custkey // 8 AS n,
                  'r' || c_nationkey || '/p' || (c_custkey // 8) AS dir FROM customer)
SELECT repo, dir, 0 AS elem_pos, 'MOYEN' AS severity, 'feature_envy' AS smell_type, dir AS file,
       CAST(n + 1 AS INTEGER) AS line, 'P' || n AS component, 'Faible' AS effort
FROM p WHERE n <> 49 AND n % 7 <> 3
UNION ALL
SELECT repo, dir, 1, 'FAIBLE', 'layer_violation', dir || '/x.py', 0, '', 'Élevé' FROM p WHERE n <> 49 AND n % 7 <> 3
"""

APPLY_ENRICHMENT = _PY_FINDINGS + ",\n" + _ENRICHED.strip() + """
SELECT repo, severity, smell_type, file, line, component, metrics, pattern, new_effort AS effort,
       explanation, refactor_before, refactor_after
FROM enr
"""

PARSE_DEEP = """
SELECT event_id, 'pkg/u' || user_id || '.go' AS default_file, 0 AS elem_pos,
       CASE event_type WHEN 'click' THEN 'CRITIQUE' WHEN 'error' THEN 'MOYEN' WHEN 'view' THEN 'CRITIQUE'
            ELSE 'FAIBLE' END AS severity,
       event_type AS smell_type, 'pkg/u' || user_id || '.go' AS file, CAST(event_id % 500 AS INTEGER) AS line,
       'U' || user_id || '.' || event_type AS component, 'Observer' AS pattern,
       CASE event_type WHEN 'click' THEN 'Élevé' WHEN 'purchase' THEN 'Moyen' ELSE 'Faible' END AS effort,
       'event ' || event_id AS explanation, '' AS refactor_before, '' AS refactor_after
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
UNION ALL
SELECT event_id, 'pkg/u' || user_id || '.go', 1, 'FAIBLE', 'feature_envy', 'pkg/f' || event_id || '.go',
       CAST(event_id % 97 AS INTEGER), '', '', 'Faible', '', '', ''
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
"""

# ---------------------------------------------------------------- skeletons
_PY_SKEL = """
pyskel AS (
  SELECT b.repo, b.path, 'r' || c.n || '/p' || (b.k // 8) AS dir,
    concat_ws(chr(10),
      '# customer ' || b.k || ': if for while and or', 'import os', '', 'class C_' || b.k || ':',
      i1 || '\"\"\"Customer ' || b.k || ' or nothing.\"\"\"', i1 || 'def __init__(self, name):', '        ...',
      CASE WHEN b.k % 17 = 0 THEN i1 || i1 || 'def _inner(v):' || chr(10) || '            ...' END,
      pm.ms,
      CASE WHEN b.k % 11 = 0 THEN i1 || 'def helper_' || b.k || '(x):' || chr(10) || '        ...' END,
      CASE WHEN b.k % 13 = 0 THEN i1 || 'async def fetch(self):' || chr(10) || '        ...' END,
      CASE WHEN b.k % 19 = 0 THEN 'class C_' || b.k || '(Base):' || chr(10) || i1 || 'def extra(self):'
           || chr(10) || '        ...' END) AS skeleton
  FROM (SELECT base.*, CASE WHEN k % 5 = 0 THEN chr(9) ELSE '    ' END AS i1 FROM base) b
  JOIN c USING (k)
  LEFT JOIN (SELECT k, string_agg(CASE WHEN k % 5 = 0 THEN chr(9) ELSE '    ' END || 'def m_' || l_orderkey
                    || '_' || l_linenumber || '(self, x):' || chr(10) || '        ...', chr(10)
                    ORDER BY l_orderkey, l_linenumber, q) AS ms
             FROM li GROUP BY k) pm USING (k))
"""

_APP_SKELETON = """package app

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
) (int, error) { /* 17 lines */ }

func (s *Service) Run(m map[string][]int, g Gen[string, int]) error { /* 7 lines */ }
"""
_PG_SKELETON = """package store

type PG struct {
\tID int
}

type Reader interface {
\tRead() int
}

func Open(m map[string][]int) error { return nil }
"""
_MADE_SKELETON = "// Code generated by maker. DO NOT EDIT.\n\npackage app\n\ntype Written struct{ y int }\n"

_GO_SKEL = """
gof AS (SELECT o_custkey AS k, string_agg(chr(9) || 'F_' || o_orderkey || ' int', chr(10) ORDER BY o_orderkey) AS fs
        FROM orders GROUP BY 1),
goskel AS (
  SELECT b.repo, b.spath AS path, b.dir,
    concat_ws(chr(10), 'package g' || (b.k // 8), '',
      '// Cust_' || b.k || ' keeps "quoted {{ braces" and if for case words.',
      CASE WHEN b.k % 2 = 0 THEN 'type Store_' || b.k || ' struct {{' || chr(10) || chr(9) || 'id int' || chr(10) || '}}'
           ELSE 'type Store_' || b.k || ' interface {{' || chr(10) || chr(9) || 'Get() int' || chr(10) || '}}' END,
      '', 'type Cust_' || b.k || ' struct {{', chr(9) || 'db *Store_' || b.k, gof.fs,
      CASE WHEN b.k % 3 = 0 THEN chr(9) || 'Base' END,
      CASE WHEN b.k % 4 = 0 THEN chr(9) || 'a, b int' END,
      CASE WHEN b.k % 5 = 0 THEN chr(9) || 'cache, x *Cache_' || b.k || chr(10) || chr(9) || 'logger *log.Logger' END,
      '}}', '', 'func New_' || b.k || '() *Cust_' || b.k || ' {{ return nil }}', '') AS skeleton
  FROM gbase b LEFT JOIN gof USING (k)
  UNION ALL
  SELECT b.repo, b.dir || '/c_' || m.k || '_' || m.st || '.go', b.dir,
    'package g' || (m.k // 8) || chr(10) || chr(10)
    || string_agg('func (c ' || CASE WHEN m.k % 7 = 0 THEN '' ELSE '*' END || 'Cust_' || m.k || ') M_'
                  || m.l_orderkey || '_' || m.l_linenumber || '(x int, y int) int {{ /* ' || (m.sz - 3)
                  || ' lines */ }}' || chr(10), chr(10) ORDER BY m.l_orderkey, m.l_linenumber, m.q)
  FROM gm m JOIN gbase b USING (k) GROUP BY b.repo, b.dir, m.k, m.st
  UNION ALL SELECT repo, dir || '/app.go', dir, replace('{app}', '<k>', CAST(k AS VARCHAR)) FROM gext
  UNION ALL SELECT repo, dir || '/store/pg.go', dir || '/store', '{pg}' FROM gext),
gogen AS (
  SELECT repo, dir || '/made.go' AS path, dir, '{made}' AS skeleton FROM gext
  UNION ALL SELECT repo, dir || '/gen/g.go', dir || '/gen', 'package gen

type Made_' || k || ' struct{{ x int }}
' FROM gext)
"""

_GO_SKEL = _GO_SKEL.format(app=_APP_SKELETON, pg=_PG_SKELETON, made=_MADE_SKELETON)

PY_SKELETON = _with(PY_BASE, _PY_SKEL) + "\nSELECT * FROM pyskel"
GO_SKELETON = _with(GO_BASE, _GO_SKEL) + "\nSELECT * FROM goskel UNION ALL SELECT * FROM gogen"

PACKAGE_SKETCHES = _with(PY_BASE, _PY_SKEL, GO_BASE, _GO_SKEL) + """
SELECT repo, dir, language, string_agg(path, ',' ORDER BY path) AS files,
       string_agg(mark || ' === ' || path || ' ===' || chr(10) || chr(10) || skeleton || chr(10) || chr(10), ''
                  ORDER BY path) AS source
FROM (SELECT *, 'python' AS language, '#' AS mark FROM pyskel
      UNION ALL SELECT *, 'go', '//' FROM goskel)
GROUP BY repo, dir, language
"""

# ---------------------------------------------------------------- extensions
PRIMITIVE_OBSESSION_GO = _with(GO_BASE) + """
SELECT repo, 'MOYEN' AS severity, 'primitive_obsession' AS smell_type, dir || '/app.go' AS file, 29 AS line,
       'Service' AS component, 'primitive_fields=3' AS metrics, 'Value Object' AS pattern, 'Faible' AS effort FROM gext
"""
PRIMITIVE_OBSESSION_PY = """
SELECT 'r' || c_nationkey AS repo, 'MOYEN' AS severity, 'primitive_obsession' AS smell_type,
       'r' || c_nationkey || '/e' || c_custkey || '/shape.py' AS file, 2 AS line, 'Client_' || c_custkey || '.__init__' AS component,
       'primitive_fields=3' AS metrics, 'Value Object' AS pattern, 'Faible' AS effort
FROM customer WHERE c_custkey % 4 = 1
"""

SCORE_HISTORY = """
WITH s AS (
  SELECT 'r' || (user_id % 25) AS repo, event_id AS scan_id, ts,
         CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS score, CAST(event_id % 40 AS INTEGER) AS findings
  FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, scan_id DESC) AS rank FROM s)
SELECT repo, scan_id, score, findings, CAST(rank AS INTEGER) AS rank,
       score - lag(score) OVER (PARTITION BY repo ORDER BY ts, scan_id) AS trend
FROM t WHERE rank <= 10
"""

FINDINGS_BY_FILE = _PY_FINDINGS + """
SELECT repo, file, CAST(count(*) AS BIGINT) AS n, string_agg(component, ',' ORDER BY line, component) AS components
FROM pyf WHERE severity IN ('CRITIQUE', 'MOYEN') AND smell_type = 'high_complexity'
GROUP BY repo, file
"""

# ---------------------------------------------------------------- scopes, params, calls, imports
PY_SCOPES = _with(PY_BASE, """
sc AS (
  SELECT k, 4 AS line, 0 AS indent, true AS hdr, 'class' AS kind, 'C_' || k AS name FROM base
  UNION ALL SELECT k, 6, 4, true, 'func', '__init__' FROM base
  UNION ALL SELECT k, 8 + n_o, 8, true, 'func', '_inner' FROM base WHERE k % 17 = 0
  UNION ALL SELECT k, 10 + n_o, 8, false, NULL, NULL FROM base WHERE k % 17 = 0
  UNION ALL SELECT k, CAST(line AS INTEGER), 4, true, 'func', 'm_' || l_orderkey || '_' || l_linenumber FROM ml
  UNION ALL SELECT k, e + 1, 4, true, 'func', 'helper_' || k FROM ends WHERE k % 11 = 0
  UNION ALL SELECT k, e + 1 + 2 * CAST(k % 11 = 0 AS INTEGER), 4, false, NULL, NULL FROM ends WHERE k % 13 = 0
  UNION ALL SELECT k, e + 1 + 2 * CAST(k % 11 = 0 AS INTEGER) + 2 * CAST(k % 13 = 0 AS INTEGER), 0, true, 'class',
                   'C_' || k FROM ends WHERE k % 19 = 0
  UNION ALL SELECT k, e + 2 + 2 * CAST(k % 11 = 0 AS INTEGER) + 2 * CAST(k % 13 = 0 AS INTEGER), 4, true, 'func',
                   'extra' FROM ends WHERE k % 19 = 0)
""") + """
SELECT b.repo, b.path, h.kind, h.name, CAST(h.indent AS INTEGER) AS indent, CAST(h.line AS INTEGER) AS start_line,
       CAST((SELECT min(r.line) FROM sc r WHERE r.k = h.k AND r.line > h.line AND r.indent <= h.indent) AS INTEGER)
         AS end_line
FROM sc h JOIN base b USING (k) WHERE h.hdr
"""

GO_PARAMS = _with(GO_BASE) + """
SELECT b.repo, b.dir || '/c_' || m.k || '_' || m.st || '.go' AS path,
       'M_' || m.l_orderkey || '_' || m.l_linenumber AS func, CAST(m.line AS INTEGER) AS line,
       p.idx, p.name, 'int' AS type
FROM gml m JOIN gbase b USING (k)
CROSS JOIN (SELECT 0 AS idx, 'x' AS name UNION ALL SELECT 1, 'y') p
UNION ALL
SELECT repo, dir || p.file, p.func, p.line, p.idx, p.name, p.type FROM gext CROSS JOIN (VALUES
  ('/app.go', 'Évaluer', 44, 0, 'a', 'int'), ('/app.go', 'Évaluer', 44, 1, 'cb', 'func(...)'),
  ('/app.go', 'Évaluer', 44, 2, 'opts', '...string'), ('/app.go', 'Run', 67, 0, 'm', 'map[string][]int'),
  ('/app.go', 'Run', 67, 1, 'g', '?'), ('/store/pg.go', 'Open', 11, 0, 'm', 'map[string][]int')) p(file, func, line, idx, name, type)
"""

GO_CALLS = _with(GO_BASE) + """
SELECT b.repo, b.dir || '/c_' || m.k || '_' || m.st || '.go' AS path, CAST(m.line AS INTEGER) AS func_line,
       'helper.Sum' AS call, 1 AS rank
FROM gml m JOIN gbase b USING (k)
UNION ALL
SELECT repo, dir || '/app.go', 44, 'fmt.A' || i, CAST(i AS INTEGER) FROM gext CROSS JOIN range(1, 11) t(i)
UNION ALL
SELECT repo, dir || '/app.go', 67, 'st.Open', 1 FROM gext
"""

GO_IMPORTS = _with(GO_BASE) + """
SELECT repo, dir || '/app.go' AS path, 4 AS line, CAST(NULL AS VARCHAR) AS alias, 'fmt' AS import_path FROM gext
UNION ALL SELECT repo, dir || '/app.go', 5, 'st', 'example.com/org/e' || k || '/store' FROM gext
"""


def _sql_lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _package_prompts() -> str:
    from ..functions import patterns as P
    head1 = P.PROMPT_PACKAGE_HEAD.split("{language}")[0]
    mid = P.PROMPT_PACKAGE_HEAD.split("{language}")[1].split("{dir}")[0]
    tail_head = P.PROMPT_PACKAGE_HEAD.split("{dir}")[1]
    return _with(PY_BASE, _PY_SKEL, GO_BASE, _GO_SKEL, "allf AS (" + "\nUNION ALL\n".join([
        PY_GOD_CLASS_ROWS, PY_HIGH_COMPLEXITY_ROWS, GO_GOD_STRUCT_ROWS, GO_CONCRETE_DEP_ROWS,
        GO_HIGH_COMPLEXITY_ROWS]) + ")") + f""",
sk AS (
  SELECT repo, dir, language,
         string_agg(mark || ' === ' || path || ' ===' || chr(10) || chr(10) || skeleton || chr(10) || chr(10), ''
                    ORDER BY path) AS source
  FROM (SELECT *, 'python' AS language, '#' AS mark FROM pyskel
        UNION ALL SELECT *, 'go', '//' FROM goskel)
  GROUP BY repo, dir, language),
skip AS (
  SELECT repo, regexp_replace(file, '/[^/]*$', '') AS dir,
         string_agg('  - ' || smell_type || ' at line ' || line || ' in ' || regexp_extract(file, '[^/]*$', 0)
                    || ' (' || component || ')' || chr(10), '' ORDER BY file, line, smell_type, component) AS lines
  FROM allf GROUP BY 1, 2)
SELECT sk.repo, sk.dir, sk.language,
       {_sql_lit(head1)} || sk.language || {_sql_lit(mid)} || sk.dir || {_sql_lit(tail_head)}
       || CASE WHEN skip.lines IS NOT NULL THEN {_sql_lit(P.PROMPT_PACKAGE_SKIP)} || skip.lines || chr(10) ELSE '' END
       || {_sql_lit(P.PROMPT_PACKAGE_TAIL)} || sk.source AS prompt
FROM sk LEFT JOIN skip USING (repo, dir)
"""


PACKAGE_PROMPTS = _package_prompts()

# ---------------------------------------------------------------- summaries
_GO_SUMMARY_LISTS = """
gof2 AS (SELECT o_custkey AS k, string_agg('{"name":"F_' || o_orderkey || '","type":"int"}', ',' ORDER BY o_orderkey) AS fs
         FROM orders GROUP BY 1),
gms AS (SELECT k, st, string_agg('{"name":"M_' || l_orderkey || '_' || l_linenumber || '","line":' || line
                                 || ',"params":["x int","y int"],"complexity":'
                                 || (1 + q + 2 * CAST(k % 5 = 0 AS INTEGER) + CAST(k % 6 = 0 AS INTEGER))
                                 || ',"lines":' || (sz - 1) || ',"calls":["helper.Sum"]}', ','
                                 ORDER BY line) AS ms
        FROM gml GROUP BY k, st)
"""
_GO_SUMMARY_SELECT = """
SELECT b.repo, b.spath AS path,
  '{"file":"' || b.spath || '","package":"g' || (b.k // 8) || '","types":['
  || CASE WHEN b.k % 2 = 0 THEN '{"name":"Store_' || b.k || '","kind":"struct","line":4,"fields":[{"name":"id","type":"int"}]},' ELSE '' END
  || '{"name":"Cust_' || b.k || '","kind":"struct","line":8,"fields":[{"name":"db","type":"*Store_' || b.k || '"}'
  || coalesce(',' || gof2.fs, '')
  || CASE WHEN b.k % 3 = 0 THEN ',{"name":"Base","type":"Base"}' ELSE '' END
  || CASE WHEN b.k % 4 = 0 THEN ',{"name":"a","type":"int"},{"name":"b","type":"int"}' ELSE '' END
  || CASE WHEN b.k % 5 = 0 THEN ',{"name":"cache","type":"*Cache_' || b.k || '"},{"name":"x","type":"*Cache_' || b.k
          || '"},{"name":"logger","type":"*log.Logger"}' ELSE '' END
  || ']}],"funcs":[{"name":"New_' || b.k || '","line":'
  || (12 + b.n_o + CAST(b.k % 3 = 0 AS INTEGER) + CAST(b.k % 4 = 0 AS INTEGER) + 2 * CAST(b.k % 5 = 0 AS INTEGER))
  || ',"complexity":1,"lines":1}]}' AS json
FROM gbase b LEFT JOIN gof2 USING (k)
UNION ALL
SELECT b.repo, b.dir || '/c_' || m.k || '_' || m.st || '.go',
  '{"file":"' || b.dir || '/c_' || m.k || '_' || m.st || '.go' || '","package":"g' || (m.k // 8)
  || '","types":[{"name":"Cust_' || m.k || '","kind":"struct","line":0,"methods":[' || m.ms || ']}]}'
FROM gms m JOIN gbase b USING (k)
UNION ALL
SELECT repo, dir || '/app.go', '{"file":"' || dir || '/app.go","package":"app","imports":["fmt","example.com/org/e' || k || '/store"],"types":['
  || '{"name":"real_' || k || '","kind":"struct","line":9,"fields":[{"name":"dsn","type":"string"}]},'
  || '{"name":"Gen","kind":"struct","line":19,"fields":[{"name":"item","type":"V"}]},'
  || '{"name":"Service","kind":"struct","line":29,"fields":[{"name":"cache","type":"*st.PG"},{"name":"repo","type":"st.Reader"},'
  || '{"name":"db","type":"MyDB"},{"name":"store","type":"Deep"},{"name":"client","type":"*?"},{"name":"queue","type":"[]real_' || k || '"},'
  || '{"name":"bus","type":"Short"},{"name":"logger","type":"*log.Logger"},{"name":"OrderID","type":"string"},{"name":"UserID","type":"string"},'
  || '{"name":"ClientEmail","type":"string"},{"name":"*st.PG","type":"*st.PG"},{"name":"?","type":"?"}],'
  || '"methods":[{"name":"Run","line":67,"params":["m map[string][]int","g ?"],"complexity":3,"lines":9,"calls":["st.Open"]}]}],'
  || '"funcs":[{"name":"Évaluer","line":44,"params":["a int","cb func(...)","opts ...string"],"complexity":1,"lines":22,'
  || '"calls":["fmt.A1","fmt.A2","fmt.A3","fmt.A4","fmt.A5","fmt.A6","fmt.A7","fmt.A8","fmt.A9","fmt.A10"]}]}' FROM gext
UNION ALL
SELECT repo, dir || '/store/pg.go', '{"file":"' || dir || '/store/pg.go","package":"store","types":[{"name":"PG","kind":"struct","line":3,"fields":[{"name":"ID","type":"int"}]}],'
  || '"funcs":[{"name":"Open","line":11,"params":["m map[string][]int"],"complexity":1,"lines":1}]}' FROM gext
UNION ALL
SELECT repo, dir || '/made.go', '{"file":"' || dir || '/made.go","package":"app","types":[{"name":"Written","kind":"struct","line":5,"fields":[{"name":"y","type":"int"}]}]}' FROM gext
UNION ALL
SELECT repo, dir || '/gen/g.go', '{"file":"' || dir || '/gen/g.go","package":"gen","types":[{"name":"Made_' || k || '","kind":"struct","line":3,"fields":[{"name":"x","type":"int"}]}]}' FROM gext
"""

GO_SUMMARY = _with(GO_BASE, _GO_SUMMARY_LISTS) + _GO_SUMMARY_SELECT

_PM2 = """
pm2 AS (SELECT k, string_agg('{"name":"m_' || l_orderkey || '_' || l_linenumber || '","line":' || CAST(line AS INTEGER)
                             || ',"complexity":' || (1 + q + CAST(k % 7 = 0 AS INTEGER)) || '}', ','
                             ORDER BY line) AS ms FROM ml GROUP BY k)
"""

_PY_SUMMARY_SELECT = """
SELECT e.repo, e.path,
  '{"file":"' || e.path || '","types":['
  || CASE WHEN e.k % 19 = 0 THEN '{"name":"C_' || e.k || '","kind":"class","line":4},' ELSE '' END
  || '{"name":"C_' || e.k || '","kind":"class","line":'
  || CASE WHEN e.k % 19 = 0 THEN e.e + 1 + 2 * CAST(e.k % 11 = 0 AS INTEGER) + 2 * CAST(e.k % 13 = 0 AS INTEGER)
          ELSE 4 END
  || ',"methods":[{"name":"__init__","line":6,"complexity":1}' || coalesce(',' || pm2.ms, '')
  || CASE WHEN e.k % 19 = 0 THEN ',{"name":"extra","line":'
          || (e.e + 2 + 2 * CAST(e.k % 11 = 0 AS INTEGER) + 2 * CAST(e.k % 13 = 0 AS INTEGER)) || ',"complexity":1}'
          ELSE '' END
  || ']}]'
  || CASE WHEN e.k % 17 = 0 OR e.k % 11 = 0 THEN ',"funcs":['
          || concat_ws(',', CASE WHEN e.k % 17 = 0 THEN '{"name":"_inner","line":' || (8 + e.n_o) || ',"complexity":2}' END,
                       CASE WHEN e.k % 11 = 0 THEN '{"name":"helper_' || e.k || '","line":' || (e.e + 1) || ',"complexity":2}' END)
          || ']' ELSE '' END
  || '}' AS json
FROM ends e LEFT JOIN pm2 USING (k)
"""

PY_SUMMARY = _with(PY_BASE, _PM2) + _PY_SUMMARY_SELECT


def _deep_file_prompts(ctes: list[str], summary: str, findings: list[str]) -> str:
    from ..functions import patterns as P
    return _with(*ctes, "pyf AS (" + "\nUNION ALL\n".join(findings) + ")",
                 "summ AS (" + summary + ")",
                 """skip AS (SELECT repo, file AS path,
                      string_agg('  - ' || smell_type || ' at line ' || line || ' (' || component || ')' || chr(10), ''
                                 ORDER BY line, smell_type, component) AS lines
                    FROM pyf GROUP BY 1, 2)""") + f"""
SELECT s.repo, s.path,
       {_sql_lit(P.PROMPT_FILE_HEAD)}
       || CASE WHEN k.lines IS NOT NULL THEN {_sql_lit(P.PROMPT_FILE_SKIP)} || k.lines || chr(10) ELSE '' END
       || {_sql_lit(P.PROMPT_FILE_TAIL)} || {_TWO_SPACES} AS prompt
FROM summ s LEFT JOIN skip k USING (repo, path)
"""


#: DuckDB indents by four spaces; no value holds a line break.
_TWO_SPACES = """array_to_string(list_transform(string_split(json_pretty(s.json), chr(10)),
         lambda l: repeat(' ', (len(l) - len(ltrim(l, ' '))) // 2) || ltrim(l, ' ')), chr(10))"""

DEEP_FILE_PROMPTS = _deep_file_prompts(
    [PY_BASE, _PM2], _PY_SUMMARY_SELECT, [PY_GOD_CLASS_ROWS, PY_HIGH_COMPLEXITY_ROWS])
DEEP_FILE_PROMPTS_GO = _deep_file_prompts(
    [GO_BASE, _GO_SUMMARY_LISTS], _GO_SUMMARY_SELECT, [GO_GOD_STRUCT_ROWS, GO_CONCRETE_DEP_ROWS, GO_HIGH_COMPLEXITY_ROWS])


_DEEP_ROWS = """
SELECT 'r' || (user_id % 25) AS repo,
       CASE event_type WHEN 'click' THEN 'CRITIQUE' WHEN 'error' THEN 'MOYEN' WHEN 'view' THEN 'CRITIQUE'
            ELSE 'FAIBLE' END AS severity
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
UNION ALL
SELECT 'r' || (user_id % 25), 'FAIBLE' FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
"""

REPO_SCORE_WITH_DEEP = ALL_FINDINGS + ",\n" + "deepf AS (" + _DEEP_ROWS + ")" + """
SELECT r.repo, CAST(greatest(0, 100 - coalesce(sum(CASE f.severity WHEN 'CRITIQUE' THEN 15
             WHEN 'MOYEN' THEN 7 WHEN 'FAIBLE' THEN 3 ELSE 0 END), 0)) AS INTEGER) AS score
FROM repos r LEFT JOIN (SELECT repo, severity FROM allf UNION ALL SELECT repo, severity FROM deepf) f USING (repo)
GROUP BY r.repo
"""


CORPUS_FILTER = """
WITH p AS (
  SELECT 'r' || (p_partkey % 25) AS repo, p_partkey, p_partkey % 8 AS d,
         lower(replace(p_type, ' ', '_')) AS name FROM part),
s AS (SELECT *, ['venv', 'pkg.egg-info', '__pycache__', 'build', 'src', 'lib/.tox', 'app/core', 'vendor'][d + 1] AS seg
      FROM p)
SELECT repo, p_partkey, seg || '/' || name || '.py' AS path, 'python' AS lang FROM s WHERE d IN (4, 6, 7)
UNION ALL
SELECT repo, p_partkey, seg || '/' || name || '.go', 'go' FROM s WHERE d <> 7
"""


IGNORE_FILTER = """
WITH p AS (
  SELECT 'r' || (p_partkey % 25) AS repo, p_partkey % 25 AS nk, p_partkey, p_partkey % 8 AS d,
         lower(replace(p_type, ' ', '_')) AS name FROM part),
s AS (SELECT *, ['venv', 'pkg.egg-info', '__pycache__', 'build', 'src', 'lib/.tox', 'app/core', 'vendor'][d + 1] AS seg,
             ['medium', 'standard', 'large', 'promo', 'small', 'economy'][nk % 6 + 1] AS word
      FROM p WHERE d IN (4, 6, 7))
SELECT repo, p_partkey, seg || '/' || name || '.py' AS path
FROM s
WHERE NOT (seg = 'src' OR (seg = 'app/core' AND NOT ends_with(name, word))
           OR (seg = 'vendor' AND name[1] > 'l' AND ends_with(name, '_steel')))
"""


REPORT_JSON_DOCUMENT = ALL_FINDINGS + ",\n" + _SCORE.strip() + f""",
fr AS (
  SELECT repo, {_RANK} AS rank, file, line, smell_type, component,
         '{{"severity":"' || severity || '","smell_type":"' || smell_type || '","file":"' || file
         || '","line":' || line || ',"component":"' || component || '","metrics":' || {_METRICS_JSON}
         || ',"pattern":"' || pattern || '","effort":"' || effort || '"}}' AS json,
         row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, file, line, smell_type, component) AS rn
  FROM allf)
SELECT repo, -1 AS rank, '' AS file, 0 AS line, '' AS smell_type, '' AS component,
       '{{"dir":"' || repo || '","score":' || score
       || CASE WHEN repo IN (SELECT repo FROM fr) THEN ',"findings":[' ELSE ',"findings":null}}' END AS json
FROM scores
UNION ALL
SELECT repo, rank, file, line, smell_type, component, CASE WHEN rn = 1 THEN json ELSE ',' || json END FROM fr
UNION ALL
SELECT DISTINCT repo, 9, '', 0, '', '', ']}}' FROM fr
"""
