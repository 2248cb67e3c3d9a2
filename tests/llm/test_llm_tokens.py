"""Token operators against the libraries."""

import hashlib

import numpy as np
import public_tokenizers as tok
from tokenizers import Tokenizer

from srclens.llm import bpe_codec, token_cache
from srclens.llm.common import shared_dir

RANKS = tok.path("byte_bpe_50k.tiktoken")


def _expected(text):
    ids = bpe_codec.encoder(RANKS, tok.PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunked_encoding_equals_the_library(odd, prose):
    for docs in (odd, prose):
        rows = docs.select("doc_id", "text").collect()
        got = bpe_codec.encode(docs, RANKS, tok.PATTERN, chunk=300, overlap=40).collect()
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(str((r.doc_id, *_expected(r.text))) for r in rows)


def test_ids_are_returned_and_decode(spark, odd):
    rows = {str(r.doc_id): r.text or "" for r in odd.collect()}
    coded = bpe_codec.encode(odd, RANKS, tok.PATTERN, chunk=300, overlap=40)
    got = bpe_codec.decode(coded, RANKS, tok.PATTERN).collect()
    assert len(got) == odd.count() and all(r.ids == bpe_codec.encoder(RANKS, tok.PATTERN).encode_ordinary(rows[str(r.doc_id)]) for r in got)
    assert all(bytes(r.decoded).decode() == rows[str(r.doc_id)] for r in got)


def test_no_boundary_in_the_overlap(spark):
    text = "a" * 1000 + " " * 700 + "b'll" * 100 + "1" * 500
    got = bpe_codec.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, tok.PATTERN, chunk=64, overlap=8).first()
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == _expected(text)


def test_empty_tables(none):
    assert bpe_codec.encode(none, RANKS, tok.PATTERN).count() == 0
    cache = token_cache.fresh_cache(shared_dir(none.sparkSession))
    assert token_cache.count_tokens(none, tok.path("word_bpe_49k.json"), cache).count() == 0


def test_counts_equal_the_library_and_the_cache_fills_once(spark, odd):
    path = tok.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    special = spark.createDataFrame([(20, "a <|endoftext|>b <|startoftext|>"), (21, "it's  I'LL\x1cx y")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(special)
    cache = token_cache.fresh_cache(shared_dir(spark))
    for _ in range(2):
        got = token_cache.count_tokens(docs, path, cache).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
        kept = spark.read.parquet(cache)
        assert kept.count() == kept.select("digest").distinct().count()


def test_sentencepiece_files_count_whole_texts(spark):
    import sentencepiece
    path = tok.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello  world"), (2, "Hello world ")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(docs, path, token_cache.fresh_cache(shared_dir(spark))).collect()}
    assert got == {r.doc_id: len(sp.encode(r.text)) for r in docs.collect()}
