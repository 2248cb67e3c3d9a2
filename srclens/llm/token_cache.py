"""Token counts by a digest cache.

The cache is a Parquet table (digest, version, n_tokens) in a shared folder.
The digest is SHA-256 of the normalised text, the version SHA-256 of the
tokenizer file with the normalisation's name. Rows whose pair of digests is
stored take their count from the table; of the rest one text per digest is
encoded and appended. The normalisation, one space for every run of ASCII
white space and none at the ends, cannot change a count of the tokenizers
it is meant for, which drop white space before they merge (``collapses``;
other tokenizers use the text as it is).

Encoding splits such texts at spaces, where no token can span, and keeps
the counts of words in a bounded dictionary per worker. Null or empty text
has no tokens. Repeated rows each give a row. Extra columns are ignored; two
runs that append the same digest store the same count and readers take one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import stage

SCHEMA = "digest binary, version string, n_tokens long"
#: Words a worker keeps.
KEPT = 1 << 18


def collapses(path: str) -> bool:
    """Whether the tokenizer file drops white space and splits at it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    added = [a["content"] for a in t.get("added_tokens", [])]
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and "[^\\s" in str(first.get("pattern")) and not any(c.isspace() for a in added for c in a)
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in t.get("added_tokens", [])))


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + (b"|spaces" if collapses(path) else b"|exact")).hexdigest()


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    """texts -> token counts, as the tokenizer's library gives them."""
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def _count(path: str, by_word: bool):
    def run(batches):
        count, kept = _counter(path), {}
        for b in batches:
            n = []
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                some = texts[at:at + 256]
                if not by_word:
                    n += count(some)
                    continue
                split = [x.split(" ") if x else [] for x in some]
                new = list({w for ws in split for w in ws if w not in kept})
                if len(kept) + len(new) > KEPT:
                    kept.clear()
                    new = list({w for ws in split for w in ws})
                kept.update(zip(new, count(new)))
                n += [sum(map(kept.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])
    return run


def stored(spark, cache: str, v: str) -> DataFrame | None:
    """digest, n_tokens of the cache's rows of one version; None without a cache."""
    try:
        kept = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException:
        return None
    return kept.filter(F.col("version") == v).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; encodes only what the cache lacks and appends it."""
    spark, by_word, v = docs.sparkSession, collapses(path), version(path)
    raw = F.coalesce(F.col(text), F.lit(""))
    normal = F.regexp_replace(F.regexp_replace(raw, "[\\x20\\x09-\\x0D]+", " "), "^ | $", "") if by_word else raw
    d = docs.select(F.col(key).alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), normal.alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = stored(spark, cache, v)
    todo = d.select("digest", "text")
    if known is not None:
        todo = todo.join(known.select("digest"), "digest", "left_anti")
    new = (todo.dropDuplicates(["digest"]).mapInArrow(_count(path, by_word), "digest binary, n_tokens long")
           .select("digest", F.lit(v).alias("version"), "n_tokens"))
    new.write.mode("append").parquet(cache)
    out = d.drop("text").join(stored(spark, cache, v), "digest", "left")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(base: str) -> str:
    return f"{base}/token-cache-{uuid.uuid4().hex}"
