"""Language identification with hyperdimensional n-gram profiles.

Every symbol (lower-cased letter, or one space for anything between letters)
has a random vector of +1 and -1, drawn from its code point. A trigram is
the product of its letters' vectors, each rotated by its place; a text is
the sum of its trigrams; a language's prototype is the sum of its training
texts. Sums run inside the partitions, so training moves one vector per
language and task. The prediction is the prototype with the largest cosine.

Null texts and texts without a letter are ``und`` with score 0; so is every
text when there is no training row. Ties go to the smallest language name.
Rows with a null language are not learned from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

DIM = 1024
_ALPHA: dict[int, bool] = {}


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, symbol) of all texts: letters as code points, 32 between and around words."""
    joined = "\0".join(("" if t is None else t).replace("\0", " ") for t in texts) + "\0"
    cp = np.frombuffer(joined.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    found, at = np.unique(cp, return_inverse=True)
    for c in found.tolist():
        if c not in _ALPHA:
            _ALPHA[c] = chr(c).isalpha()
    letter = np.array([_ALPHA[c] for c in found.tolist()], bool)[at]
    row = np.cumsum(cp == 0) - (cp == 0)
    sym = np.where(letter, cp, 32)
    keep = np.ones(len(sym), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    row, sym = row[keep], sym[keep]
    # a space before each text; its end has one already
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    first = first[sym[first] != 32]
    return np.insert(row, first, row[first]), np.insert(sym, first, 32)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x distinct trigrams) counts as float32, and the trigrams' symbols (n, 3)."""
    row, sym = symbols(texts)
    found, s = np.unique(sym, return_inverse=True)
    ok = row[2:] == row[:-2]
    code = ((s[:-2] * len(found) + s[1:-1]) * len(found) + s[2:])[ok]
    row = row[2:][ok]
    if len(found) ** 3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(code, minlength=1))
        rank = np.zeros(len(found) ** 3, np.int64)
        rank[grams] = np.arange(len(grams))
        col = rank[code]
    else:
        grams, col = np.unique(code, return_inverse=True)
    n = len(grams)
    c = np.bincount(row * n + col, minlength=len(texts) * n).reshape(len(texts), n).astype(np.float32) if n else np.zeros((len(texts), 0), np.float32)
    return c, found[np.stack([grams // len(found) ** 2, grams // len(found) % len(found), grams % len(found)], 1)] if n else np.zeros((0, 3), np.int64)


_LETTERS: dict[int, np.ndarray] = {}


def letter_vector(symbol: int, dim: int = DIM) -> np.ndarray:
    if symbol not in _LETTERS or len(_LETTERS[symbol]) != dim:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        _LETTERS[symbol] = np.random.RandomState(symbol + 1).randint(0, 2, dim).astype(np.int8) * 2 - 1
    return _LETTERS[symbol]


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    found, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    letters = np.stack([letter_vector(int(s), dim) for s in found])
    out = np.roll(letters, 2, 1)[at[:, 0]]
    out *= np.roll(letters, 1, 1)[at[:, 1]]
    out *= letters[at[:, 2]]
    return out


def bundles(c: np.ndarray, grams: np.ndarray, dim: int = DIM, block: int = 8192) -> np.ndarray:
    """Text vectors: counts times trigram vectors, in blocks of trigrams."""
    out = np.zeros((len(c), dim), np.float32)
    for at in range(0, len(grams), block):
        out += c[:, at:at + block] @ gram_vectors(grams[at:at + block], dim).astype(np.float32)
    return out


def _pieces(batch: pa.RecordBatch, text: str = "text"):
    """Slices small enough for a dense count matrix."""
    for part in chunks(batch, text):
        for at in range(0, len(part), 256):
            yield part.slice(at, 256)


def _learn(dim: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in _pieces(b):
                c, grams = counts(part.column("text").to_pylist())
                langs = np.array(part.column("lang").to_pylist(), object)
                if not len(grams):
                    continue
                names = sorted(set(langs))
                per = np.stack([c[langs == x].sum(0) for x in names])
                for name, v in zip(names, bundles(per, grams, dim)):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "v"])
    return run


def prototypes(train: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes: languages x dim numbers, whatever the corpus."""
    per_task = train.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(_learn(dim), "lang string, v array<double>")
    sums = per_task.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").collect()
    p = np.array([r.v for r in rows], np.float64).reshape(len(rows), dim)
    return [r.lang for r in rows], p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def _predict(keys: list[str], names: list[str], p: np.ndarray, text: str, out: tuple[str, str]):
    p = p.astype(np.float32)

    def run(batches):
        for b in batches:
            pred, score = [], []
            for part in _pieces(b, text):
                c, grams = counts(part.column(text).to_pylist())
                if not len(grams) or not names:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                v = bundles(c, grams, p.shape[1])
                cos = (v @ p.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(1)
                some = c[:, (grams != 32).any(1)].sum(1) > 0
                pred += [names[k] if ok else "und" for k, ok in zip(best, some)]
                score += np.where(some, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keys, *out])
    return run


def identify(docs: DataFrame, train: DataFrame, keep: list[str], text: str = "text", dim: int = DIM, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep columns of docs, the predicted language and its score; train has columns text and lang."""
    langs, p = prototypes(train, dim)
    d = docs.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(_predict(keep, langs, p, text, names), f"{fields}, `{names[0]}` string, `{names[1]}` double")


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~held_out & F.col("lang").isNotNull()).select("text", "lang")
