"""Registered queries of the training-data operators."""

from __future__ import annotations

import uuid

import public_tokenizers as tok
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, context_tree, fingerprints, language_id, mixing, ngram_join, nn_descent, oracles, pii, quality, residue_gemm, slots, token_cache, turn_trie
from .common import fold, read, shared_dir, stage


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group(read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    return language_id.identify(d, language_id.training_rows(d, F.col("held_out")), ["doc_id", "held_out"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache per call, so that a run shows the whole work."""
    return token_cache.count_tokens(read(spark, sf_dir, "documents"), tok.path("word_bpe_49k.json"), token_cache.fresh_cache(shared_dir(spark)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(read(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).drop("ids")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh four times those labelled bad; the others lie between."""
    d = mixing.measure(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    d = stage(d, "mix-sizes")  # the texts are read once and never moved
    q = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    w = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return mixing.mix_measured(d.join(q, "doc_id", "left"), w).select("doc_id", "size", "source_size", "target", "taken")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``; with a new store of maps per call. slot is the position in the shard."""
    store = slots.MapStore(spark, f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    placed = slots.assign(read(spark, sf_dir, "documents"), store, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op12_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residue_gemm.mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def rebuilt(keys: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 5, then c's own turns after its first h; h is crc32 of c as text, modulo 9."""
    c, w = F.col("conv_id"), turn_trie.WIDTH
    head = keys.select(c.alias("base"), F.expr(f"substring(key, 1, {8 * w})").alias("head"))
    h = keys.withColumn("base", c - c % 5).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % 9).cast("int"))
    both = h.join(head, "base", "left")
    start = F.coalesce(F.expr(f"substring(head, 1, h * {w})"), F.lit(b""))
    return both.select("conv_id", F.concat(start, F.expr(f"substring(key, h * {w} + 1)")).alias("key"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(rebuilt(turn_trie.turn_keys(read(spark, sf_dir, "conversations")))).drop("turn_id")


QUERIES = {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_fingerprints, op4_pii, op5_language, op6_token_counts, op7_bpe, op8_mix, op9_context_tree, op10_nn_descent,
                                    op11_slots, op12_residue_gemm, op13_turn_trie)}
ORACLES: dict[str, str] = oracles.ORACLES
