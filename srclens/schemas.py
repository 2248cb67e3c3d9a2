"""Spark schemas of the central tables."""

from pyspark.sql import types as T

SOURCE_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("dir", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("content", T.StringType()),
])

METRICS = T.MapType(T.StringType(), T.IntegerType())

FINDINGS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("smell_type", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("component", T.StringType()),
    T.StructField("metrics", METRICS),
    T.StructField("pattern", T.StringType()),
    T.StructField("effort", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("refactor_before", T.StringType()),
    T.StructField("refactor_after", T.StringType()),
])

FINDING_COLUMNS = [f.name for f in FINDINGS.fields]

# Model response shapes (enrichment object, deep-analysis array element).
ENRICH_RESULT = T.StructType([
    T.StructField("explanation", T.StringType()),
    T.StructField("refactor_before", T.StringType()),
    T.StructField("refactor_after", T.StringType()),
    T.StructField("effort", T.StringType()),
])

DEEP_FINDING = T.StructType([
    T.StructField("smell_type", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("effort", T.StringType()),
    T.StructField("refactor_before", T.StringType()),
    T.StructField("refactor_after", T.StringType()),
])
