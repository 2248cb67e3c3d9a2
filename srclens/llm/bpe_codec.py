"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of at most ``chunk`` characters are one piece. A longer text is cut at
every ``chunk`` characters; both neighbours of a cut see ``overlap`` more
characters around it and are pre-tokenised on their own, in parallel. The
first pre-token boundary behind the cut that both found is where they have
resynchronised: from there on both readings are the same, because a match of
the pattern depends only on what follows its start. A cut without such a
boundary is dropped, so its piece simply stays longer. The pieces between
the cuts are encoded in parallel and their ids concatenated; decode() turns a
column of ids back into bytes. Long texts are keyed by their digest, so copies are encoded once and a
lost task is recomputed with the same keys.

Null or empty text: no ids, the digests of empty bytes. Repeated rows each
give a row. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, stage

SPAN = 1 << 16
SUMS = ["ids_sha256", "decoded_sha256"]


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens that further text could not change."""
    found = [m.span() for m in regex.finditer(pattern, text)]
    return [end for _, end in found[:-2]]


def _cuts(pattern: str, chunk: int, overlap: int):
    """Per chunk: its boundaries just behind its own start and just behind its end."""
    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            head, tail = [], []
            for text, at, start in zip(rows["part"], rows["at"], rows["start"]):
                ends = np.asarray(boundaries(text, pattern), np.int64) + start
                head.append(ends[(ends >= at) & (ends < at + overlap)].tolist())
                tail.append(ends[(ends >= at + chunk) & (ends < at + chunk + overlap)].tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), b.column("at"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                ["digest", "at", "head", "tail"])
    return run


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))).cast(pa.list_(pa.int32()))


def _digests(enc: tiktoken.Encoding, ids: np.ndarray) -> tuple[str, str]:
    """Of the ids and of the bytes they decode to, SPAN ids at a time."""
    back = hashlib.sha256()
    for at in range(0, len(ids), SPAN):
        back.update(enc.decode_bytes(ids[at:at + SPAN].tolist()))
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), back.hexdigest()


def _encode(path: str, pattern: str, keys: list[str], digest: bool):
    """Ids of each piece, with digests on demand; about CHUNK bytes of text are Python objects at once."""
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            for c in chunks(b, "part"):
                ids = [np.asarray(enc.encode_ordinary(text or ""), np.int32) for text in c.column("part").to_pylist()]
                more = [pa.array(x, pa.string()) for x in zip(*(_digests(enc, x) for x in ids))] if digest else []
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in keys), _lists(ids), *more], [*keys, "ids", *(SUMS if digest else [])])
    return run


def _decode(path: str, pattern: str, ids: str, names: list[str], digest: bool):
    """The columns, then the decoded bytes or the digests of the ids and of the decoded bytes; rows go out one by one."""
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            for k in range(len(b)):
                row = b.slice(k, 1)
                x = row.column(ids)[0].values
                x = np.zeros(0, np.int32) if x is None else x.to_numpy(zero_copy_only=False).astype(np.int32)
                more = [pa.array([v], pa.string()) for v in _digests(enc, x)] if digest else [pa.array([enc.decode_bytes(x.tolist())], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), *more], [*names, *(SUMS if digest else ["decoded"])])
    return run


def _with_decoded(coded: DataFrame, path: str, pattern: str, ids: str, digest: bool) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema]
    fields += [f"{x} string" for x in SUMS] if digest else ["decoded binary"]
    return coded.mapInArrow(_decode(path, pattern, ids, coded.columns, digest), ", ".join(fields))


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """coded and decoded, the bytes of its ids column; null ids are no bytes."""
    return _with_decoded(coded, path, pattern, ids, False)


def pieces(long: DataFrame, pattern: str, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """digest, piece, part: the stitched pieces of each distinct long text (columns digest, text)."""
    n = F.length("text")
    cut = (long.withColumn("at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))))
           .withColumn("start", F.greatest(F.lit(0), F.col("at") - overlap).cast("long"))
           .select("digest", F.col("at").cast("long").alias("at"), "start",
                   F.expr(f"substring(text, int(start) + 1, int(at - start) + {chunk + 2 * overlap})").alias("part")))
    seen = cut.repartition("digest", "at").mapInArrow(_cuts(pattern, chunk, overlap), "digest string, at long, head array<long>, tail array<long>")
    w = Window.partitionBy("digest").orderBy("at")
    both = F.array_intersect("head", F.lag("tail").over(w))
    cuts = (seen.select("digest", "at", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.array_min(both)).alias("cut"))
            .filter("cut is not null").groupBy("digest").agg(F.array_sort(F.collect_list("cut")).alias("cuts")))
    spans = F.transform("cuts", lambda c, i: F.struct(c.alias("a"), F.coalesce(F.get(F.col("cuts"), i + 1), n).alias("b")))
    return (long.join(cuts, "digest").select("digest", "text", F.posexplode(spans).alias("piece", "s"))
            .selectExpr("digest", "piece", "substring(text, int(s.a) + 1, int(s.b - s.a)) as part"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """key, n_tokens, ids, ids_sha256, decoded_sha256 of every row of docs; the digests are of these ids and of what they decode to."""
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("part"))
    kind = d.schema["key"].dataType.simpleString()
    columns = ["key", "ids", *SUMS]
    short = d.filter(F.length("part") <= chunk).mapInArrow(_encode(path, pattern, ["key"], True), f"key {kind}, ids array<int>, ids_sha256 string, decoded_sha256 string")
    long = stage(d.filter(F.length("part") > chunk).select("key", F.sha2("part", 256).alias("digest"), F.col("part").alias("text")), "bpe")
    parts = pieces(long.dropDuplicates(["digest"]).select("digest", "text"), pattern, chunk, overlap)
    coded = parts.repartition("digest", "piece").mapInArrow(_encode(path, pattern, ["digest", "piece"], False), "digest string, piece int, ids array<int>")
    whole = (coded.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
             .select("digest", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
    whole = _with_decoded(whole, path, pattern, "ids", True)
    out = short.select(columns).unionByName(long.select("key", "digest").join(whole, "digest").select(columns))
    return out.select(F.col("key").alias(key), F.size("ids").cast("long").alias("n_tokens"), "ids", *SUMS)
