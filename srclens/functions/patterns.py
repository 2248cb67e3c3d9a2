"""Fixed values that must equal the analysed tool's behaviour.

Everything here is a constant of the rules being reproduced: thresholds,
labels, word lists and the regular expressions of the line scanners. The
regexes are written for Java's engine but keep RE2 semantics: ASCII word
boundaries are spelled out as look-arounds because Java's ``\\b`` is
Unicode-aware and RE2's is not.
"""

# ---- fixed values: severities, efforts, patterns, smell names ----
CRITIQUE = "CRITIQUE"
MOYEN = "MOYEN"
FAIBLE = "FAIBLE"
SEVERITIES = [CRITIQUE, MOYEN, FAIBLE]

EFFORT_HIGH = "Élevé"
EFFORT_MEDIUM = "Moyen"
EFFORT_LOW = "Faible"

PATTERN_FACADE = "Façade"
PATTERN_STRATEGY = "Stratégie"
PATTERN_DI = "Injection de dépendances"

SMELL_GOD_STRUCT = "god_struct"
SMELL_CONCRETE_DEP = "concrete_dep"
SMELL_HIGH_COMPLEXITY = "high_complexity"
SMELL_GOD_CLASS = "god_class"

# ---- fixed values: thresholds ----
CC_THRESHOLD = 10          # flag when cc > 10; > 15 medium; > 20 critical
FIELD_THRESHOLD = 10       # god struct / god class: fields > 10
METHOD_THRESHOLD = 15      # god struct / god class: methods > 15

# ---- fixed values: score ----
SCORE_PENALTY = {CRITIQUE: 15, MOYEN: 7, FAIBLE: 3}
SCORE_GOOD = 80
SCORE_WARN = 60

# ---- fixed values: injectable field names (concrete dependency rule) ----
INJECTABLE_NAMES = ["db", "database", "store", "repo", "repository", "svc",
                    "service", "client", "handler", "manager", "cache",
                    "queue", "bus", "publisher", "logger"]

# ---- fixed values: directories never scanned ----
PY_SKIP_DIRS = ["__pycache__", ".venv", "venv", ".git", "node_modules", ".tox",
                "dist", "build", ".eggs"]
PY_SKIP_DIR_SUFFIX = ".egg-info"
GO_SKIP_DIRS = ["vendor", "testdata", ".git", "node_modules"]

# ---- fixed values: generated-file markers (Go sketches only) ----
GENERATED_MARKER = "Code generated"
GENERATED_HEADER_BYTES = 512
GENERATED_PATH_PARTS = ["/generated/", "/gen/"]

# ---- regex building blocks ----
# Go's \s (RE2 Perl class): tab, newline, form feed, carriage return, space.
WS = r"[\t\n\f\r ]"
# Characters removed by Go's strings.TrimSpace (unicode.IsSpace).
GO_SPACE = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same set as a plain string of characters (for Spark's trim).
GO_SPACE_CHARS = ("\t\n\x0b\f\r \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")
NOT_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
NOT_WORD_AFTER = r"(?![A-Za-z0-9_])"

# ---- fixed values: Python line scanner ----
PY_CLASS = r"^class" + WS + r"+(\w+)"
PY_FUNC = r"^def" + WS + r"+(\w+)" + WS + r"*\("
PY_METHOD = r"^def" + WS + r"+\w+" + WS + r"*\(" + WS + r"*(?:self|cls)" + NOT_WORD_AFTER
PY_SELF_FIELD = r"^" + WS + r"+self\.(\w+)" + WS + r"*="
PY_CC_WORDS = ["if", "elif", "for", "while", "except", "and", "or"]
PY_CC_PARTS = [w for w in PY_CC_WORDS if not any(v != w and v in w for v in [*PY_CC_WORDS, "or"])]  # in every line that holds a word
PY_CC = NOT_WORD_BEFORE + "(?:" + "|".join(PY_CC_WORDS) + ")" + NOT_WORD_AFTER

# ---- fixed values: Go identifiers, words that start a type, predeclared types ----
GO_ID = r"[\p{L}_][\p{L}\p{Nd}_]*"
GO_NOT_ID_BEFORE = r"(?<![\p{L}\p{Nd}_])"
GO_NOT_ID_AFTER = r"(?![\p{L}\p{Nd}_])"
GO_TYPE_WORDS = ["func", "map", "chan", "struct", "interface"]
GO_PREDECLARED = ["any", "bool", "byte", "comparable", "complex64", "complex128", "error", "float32", "float64",
                  "int", "int8", "int16", "int32", "int64", "rune", "string", "uint", "uint8", "uint16", "uint32",
                  "uint64", "uintptr"]

# Go token pattern (type-declaration lines only). Every alternative is
# possessive so that very long literals cannot overflow the regex engine's
# stack. No whitespace tokens; numbers,
# strings, runes and operator runs are still consumed (so their text never
# yields false tokens) but are dropped right after (``GO_DROP``). '/' never
# starts an operator run before the comment alternatives had their turn.
GO_TOKEN_ANALYSIS = (
    r"(?s)//[^\n]*+"
    r"|/\*.*?\*/"
    r"|`[^`]*+`"
    r"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
    r"|'(?:\\.[^'\n]*+|[^'\\\n]++)'"
    r"|\n"
    r"|&&|\|\|"
    r"|[\p{L}_][\p{L}\p{Nd}_]*+"
    r"|\d[\w.]*+"
    r"|[{}()\[\];,.*=]"
    r"|[-+/%<>!:^|&~?]++"
    r"|[^\s\p{L}\p{Nd}_]"
)
# Chunks for masking: comments, literals, and maximal runs of other code
# (which may span lines); joined back they give the exact source.
GO_CHUNK = (
    r"(?s)//[^\n]*+"
    r"|/\*.*?\*/"
    r"|`[^`]*+`"
    r"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
    r"|'(?:\\.[^'\n]*+|[^'\\\n]++)'"
    r"|[^\"'`/]++"
    r"|[\"'`/]"
)

# Tokens dropped before any window: numbers, strings, runes, raw strings,
# single-line comments, operator runs and other symbols.
GO_KEEP = r"^(?:[\p{L}_][\p{L}\p{Nd}_]*|[{}()\[\];,.*=]|&&|\|\||\n)$"

# ---- fixed values: prompt texts of the model-assisted steps ----
PROMPT_FINDING_HEAD = ("You are a software architect expert in Go design patterns.\n"
                       "A static analysis tool detected an architectural smell:\n\n")
PROMPT_FINDING_TAIL = (
    "CRITICAL: Output ONLY a raw JSON object — no markdown, no prose, no code fences.\n"
    "Your response must start with { and end with }.\n\n"
    '{"explanation":"1-2 sentence diagnosis","refactor_before":"Go code ≤15 lines",'
    '"refactor_after":"Go code ≤15 lines","effort":"Faible|Moyen|Élevé"}')
PROMPT_PACKAGE_HEAD = ("You are an expert software architect performing deep architectural analysis.\n"
                       "Below is the skeleton of a {language} package at: {dir}\n"
                       "Function bodies have been stripped — only signatures, types, and structure remain.\n\n")
PROMPT_PACKAGE_SKIP = "Already detected by static analysis — do NOT re-flag:\n"
PROMPT_PACKAGE_TAIL = (
    "Identify architectural smells across ALL files in this package.\n"
    "Cross-file patterns are especially valuable: feature envy, layer violations, missing abstractions.\n"
    "For each finding, include the exact file path from the === FILE headers.\n\n"
    "CRITICAL: Your ENTIRE response must be a single raw JSON array. No markdown, no prose, "
    "no explanation before or after.\n"
    "Start your response with [ and end with ]. Return [] if no smells found.\n\n"
    "Each element:\n"
    '{"smell_type":"snake_case","component":"Type.method or func",'
    '"file":"exact/path/from/header.go","line":0,'
    '"severity":"CRITIQUE|MOYEN|FAIBLE","explanation":"one sentence",'
    '"pattern":"design pattern","effort":"Faible|Moyen|Élevé",'
    '"refactor_before":"snippet ≤10 lines","refactor_after":"snippet ≤10 lines"}'
    "\n\nPackage skeleton:\n")

# ---- fixed values: extensions from the planning documents ----
GO_PRIMITIVE_TYPES = ["string", "int", "float64", "bool"]
GO_DOMAIN_WORDS = ["ID", "Id", "Email", "Phone", "URL", "Path", "Name", "Code",
                   "Price", "Amount", "Total", "Count", "Status", "Token"]
PY_DOMAIN_SUFFIXES = ["_id", "_email", "_phone", "_url", "_code", "_name", "_price",
                      "_amount", "_token"]
PRIMITIVE_MIN = 3
SMELL_PRIMITIVE_OBSESSION = "primitive_obsession"
PATTERN_VALUE_OBJECT = "Value Object"
HISTORY_SCANS = 10
PROMPT_FILE_HEAD = ("You are an expert software architect performing deep architectural analysis.\n"
                    "Below is a structured AST summary of a source file — NOT raw source code.\n\n")
PROMPT_FILE_SKIP = "Already detected by static analysis — do NOT re-flag these:\n"
PROMPT_FILE_TAIL = (
    "Identify architectural smells not listed above.\n"
    "Focus on: layer violations, feature envy, missing abstractions, temporal coupling, anemic domain model.\n\n"
    "CRITICAL: Your ENTIRE response must be a single raw JSON array. No markdown, no prose, "
    "no explanation before or after.\n"
    "Start your response with [ and end with ]. Return [] if no smells found.\n\n"
    "Each element:\n"
    '{"smell_type":"snake_case","component":"Type.method or func","line":0,'
    '"severity":"CRITIQUE|MOYEN|FAIBLE","explanation":"one sentence",'
    '"pattern":"design pattern","effort":"Faible|Moyen|Élevé",'
    '"refactor_before":"snippet ≤10 lines","refactor_after":"snippet ≤10 lines"}'
    "\n\nAST summary:\n")
