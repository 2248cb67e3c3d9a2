"""Source tables from directories or tables: S1-S7.

``scan_directories`` reads the ``.py`` and ``.go`` files below any number of
roots with one ``binaryFile`` scan. Which repo a file belongs to, its relative
path, the excluded directories (S3) and each root's ``.gitignore`` (S4) are
all decided by predicates on ``_metadata.file_path``, which Spark applies to
the file listing: the bytes of excluded files are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import dir_name

#: Parts into which a repo's files are dealt where they meet its ignore rules.
SALTS = 64


def _strip_scheme(path: Column) -> Column:
    """A path as the file system lists it, without ``file:`` and repeated slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "(?<!:)/{2,}", "/")


def read_small_file(spark: SparkSession, path: str) -> str | None:
    """Text of one file through Hadoop's file systems, as the roots may be in any store; null if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def ignore_rules(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo, ordinal, pattern): the lines of the ``.gitignore`` at each root. The driver reads one small file a root."""
    rows = [(repo, n, line) for repo, root in roots.items()
            for n, line in enumerate((read_small_file(spark, root.rstrip("/") + "/.gitignore") or "").splitlines())]
    return spark.createDataFrame(rows, "repo string, ordinal int, pattern string")


def scan_directories(spark: SparkSession, roots: dict[str, str], langs: tuple[str, ...] = ("python", "go"), gitignore: bool = True) -> DataFrame:
    """source_files(repo, path, dir, lang, content) of all roots (repo -> folder) in one scan.

    ``path`` is relative to the root; a file below two roots belongs to the
    deeper one. Unreadable files are skipped, bytes that are not UTF-8 become
    replacement characters. The ignore file applies to Python files only, as
    the Go files come from a package load."""
    suffix = {"python": "py", "go": "go"}
    globs = ",".join(suffix[x] for x in langs)
    repo_of = {_plain(root): repo for repo, root in roots.items()}
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.{" + globs + "}" if len(langs) > 1 else "*." + globs)
           .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(sorted(roots.values())))
    full = _strip_scheme(F.col("_metadata.file_path"))
    parts = F.split(full, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    known = F.array(*[F.lit(r) for r in repo_of])
    root = F.element_at(F.filter(above, lambda p: F.array_contains(known, p)), -1)
    names = F.create_map(*[F.lit(x) for pair in repo_of.items() for x in pair])
    repo, path = F.element_at(names, root), F.substr(full, F.length(root) + 2)
    lang = F.when(full.endswith(".py"), F.lit("python")).otherwise(F.lit("go"))
    keep = ~excluded(path, lang)
    if gitignore and "python" in langs:
        rules = {r.repo: r.runs for r in rule_runs(ignore_rules(spark, roots)).collect()}
        for name, runs in rules.items():  # one run of alternatives per sign, so a few expressions a root
            keep = keep & ~((repo == name) & (lang == "python") & last_match(path, F.array(
                *[F.struct(F.lit(r.regex).alias("regex"), F.lit(r.neg).alias("neg")) for r in runs])))
    kept = raw.filter(keep)
    return kept.select(repo.alias("repo"), path.alias("path"), F.concat_ws("/", repo, dir_name(path)).alias("dir"), lang.alias("lang"),
                       F.make_valid_utf8(F.col("content").cast("string")).alias("content")).filter("content is not null")


def _plain(root: str) -> str:
    """A root as ``_strip_scheme`` leaves the paths below it."""
    root = root.rstrip("/")
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return root


def scan_directory(spark: SparkSession, root: str, repo: str, lang: str) -> DataFrame:
    """S1/S2/S5 of one root and language, without its ignore file."""
    return scan_directories(spark, {repo: root}, (lang,), gitignore=False)


def excluded(path: Column, lang: Column) -> Column:
    """S3: is the file below an excluded directory name (anywhere in the
    relative path)? Python also excludes any ``*.egg-info`` directory."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    python = F.exists(parts, lambda d: d.isin(*P.PY_SKIP_DIRS) | d.endswith(P.PY_SKIP_DIR_SUFFIX))
    return F.when(lang == "python", python).otherwise(F.exists(parts, lambda d: d.isin(*P.GO_SKIP_DIRS)))


def skip_dirs(files: DataFrame, lang: str) -> DataFrame:
    """S3 on a table with the column path."""
    return files.filter(~excluded(F.col("path"), F.lit(lang)))


#: Parts of an ignore pattern: wildcards, character classes, escapes, single characters.
IGNORE_PART = r"\*\*/|\*\*|\*|\?|\[[!^]?\]?(?:\\[\s\S]|[^\]\\])*\]|\\[\s\S]|[\s\S]"
NOTHING = "(?!)"


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{Nd}_\s])", r"\\$1")


def _class(t: Column) -> Column:
    """The regex of a character class; one with a reversed range matches nothing."""
    inside = F.regexp_replace(t, r"^\[[!^]?|\]$", "")
    units = F.transform(F.regexp_extract_all(inside, F.lit(r"\\[\s\S]|[\s\S]"), F.lit(0)),
                        lambda u: F.struct(F.regexp_replace(u, r"^\\([\s\S])", "$1").alias("c"), (u == "-").alias("dash")))

    def reversed_at(i: Column) -> Column:
        before, after = F.get(units, i - 1), F.get(units, i + 1)
        return F.coalesce(F.get(units, i)["dash"] & (F.ascii(before["c"]) > F.ascii(after["c"])), F.lit(False))
    bad = F.exists(F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0))), reversed_at)
    text = F.array_join(F.transform(units, lambda u: F.when(u["dash"], F.lit("-")).otherwise(_quoted(u["c"]))), "")
    return F.when(bad | (F.size(units) == 0), F.lit(NOTHING)).otherwise(
        F.concat(F.lit("(?!/)["), F.when(t.rlike(r"^\[[!^]"), F.lit("^")).otherwise(F.lit("")), text, F.lit("]")))


def ignore_regex(pattern: Column) -> Column:
    """One ignore-file line -> struct (regex on the relative path, neg), null
    for comments and blank lines.

    Covers the common syntax: ``!`` negation, a leading ``/`` anchoring to the
    root, a trailing ``/`` for directories, ``*``, ``?``, ``**``, character
    classes (``[co]``, ``[!a-z]``, escapes inside) and ``\\`` escapes. Patterns
    without a slash match at any depth."""
    line = F.regexp_replace(pattern, r"\s+$", "")
    neg = F.startswith(line, F.lit("!"))
    body = F.regexp_replace(line, "^!", "")
    anchored = F.regexp_replace(body, "/+$", "").contains("/")

    def part(t: Column) -> Column:
        return (F.when(t == "**/", F.lit("(?:.*/)?")).when(t == "**", F.lit(".*"))
                .when(t == "*", F.lit("[^/]*")).when(t == "?", F.lit("[^/]"))
                .when(t.rlike(r"^\[[\s\S]+\]$"), _class(t))
                .when(t.rlike(r"^\\[\s\S]"), _quoted(F.substring(t, 2, 1)))
                .otherwise(_quoted(t)))

    parts = F.regexp_extract_all(F.regexp_replace(body, "^/+|/+$", ""), F.lit(IGNORE_PART), F.lit(0))
    regex = F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")),
                     F.array_join(F.transform(parts, part), ""), F.lit("(?:/.*)?$"))
    return F.when((line != "") & ~F.startswith(line, F.lit("#")), F.struct(regex.alias("regex"), neg.alias("neg")))


def rule_runs(rules: DataFrame) -> DataFrame:
    """repo, runs: the rules of a repo in order, neighbours of one sign joined
    into one regex of alternatives. rules: repo, ordinal, pattern."""
    compiled = rules.withColumn("c", ignore_regex(F.col("pattern"))).filter(F.col("c").isNotNull())
    listed = compiled.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("ordinal", "c.regex", "c.neg"))).alias("rules"))
    none = F.array().cast("array<struct<regex:string,neg:boolean>>")

    def add(runs: Column, r: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        same = F.coalesce(last["neg"] == r["neg"], F.lit(False))
        regex = F.when(same, F.concat(last["regex"], F.lit("|"), r["regex"])).otherwise(r["regex"])
        kept = F.when(same, F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(runs)
        return F.concat(kept, F.array(F.struct(regex.alias("regex"), r["neg"].alias("neg"))))
    return listed.select("repo", F.aggregate("rules", none, add).alias("runs"))


def last_match(path: Column, runs: Column) -> Column:
    """Is the last run that matches the path one that ignores?"""
    return F.aggregate(runs, F.lit(False), lambda a, r: F.when(F.regexp_like(path, r["regex"]), ~r["neg"]).otherwise(a))


def ignore_filter(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop files whose last matching ignore rule is not a
    negation. ``rules`` is (repo, ordinal, pattern) with the raw lines of the
    root ignore file. A repo's files are dealt to SALTS parts, each with the
    repo's rules, so a repo with most of the files is many tasks."""
    runs = rule_runs(rules).select("repo", F.col("runs").alias("__runs"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    dealt = files.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(runs, ["repo", "__salt"], "left")
    ignored = F.coalesce(last_match(F.col("path"), F.col("__runs")), F.lit(False))
    return dealt.filter(~ignored).select(files.columns)
