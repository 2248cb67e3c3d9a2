"""Language-model scores by context-tree weighting over the bytes of texts.

A text is its lower-cased words, each with a closing space, and one end
token, a line feed. It is coded byte by byte, each byte by eight binary
decisions. The context of a byte is the five bytes before it in the running
text, so also the end of the word before; only the beginning of a text is
padded, with spaces. Every context of every depth holds Krichevsky-Trofimov
counts per decision, and the weighted probability of a node is half its own
estimate and half the product of its children's:

    P_w(s) = (P_kt(s) + prod P_w(child)) / 2,  P_w = P_kt at full depth

A decision is predicted from the depths mixed with the weights that
training left at the nodes of its path; a context never seen hands the
decision to its parent. As a byte's probability depends on its six bytes
only, it is worked out once per distinct six bytes, and a text's score is a
join of its distinct six bytes, with their number of times, with these.
Its code length per byte is given in bits. Words are counted for the unigram
base only.

All tables (words, six-byte counts, nodes) are distributed and grow with
the corpus. Trees are solved per two nearest context bytes, so one task
holds the counts below 65,536 contexts at most; the two shallow levels (65,536 contexts
at most) go through the driver. The ``TOP`` most frequent words and ``GRAMS``
most frequent six bytes are also sent to all tasks, which spares most of the
shuffle; all others take the join. Null and empty texts are the end token
alone. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_bytes, per_row_unique, stage, utf8, words

DEPTH, TOP, GRAMS = 5, 1 << 17, 1 << 20
_SYMBOL = np.arange(256)
#: For each byte, its eight (node, bit) decisions.
NODES = np.stack([(1 << k) | (_SYMBOL >> (8 - k)) for k in range(8)], 1)
BITS = np.stack([(_SYMBOL >> (7 - k)) & 1 for k in range(8)], 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after eight steps up."""
    down = np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - down


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def _nodes(context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
    """Decision nodes below contexts: (keys = context * 256 + node, sorted), n0, n1, and each row's eight positions."""
    key = context[:, None] * 256 + NODES[symbol]
    found, at = np.unique(key, return_inverse=True)
    at = at.reshape(key.shape)
    one = BITS[symbol].astype(bool)
    w = np.broadcast_to(n[:, None], key.shape)
    n1 = np.bincount(at[one], w[one], len(found))
    n0 = np.bincount(at[~one], w[~one], len(found))
    return found, n0, n1, at


def subtree(gram: np.ndarray, n: np.ndarray, top: int = 2, depth: int = DEPTH):
    """Trees below contexts of ``top`` bytes: their nodes' (keys, log P_w) and, per row and decision, P(bit = 1) and the weight left where no context was seen.

    gram: context bytes, farthest first, then the next byte."""
    symbol = gram & 255
    levels = []
    for d in range(depth, top - 1, -1):
        context = (gram >> 8) & ((1 << 8 * d) - 1)
        levels.append((d, *_nodes(context, symbol, n)))
    logw = None
    weights = []
    for d, keys, n0, n1, _ in levels:
        own = log_kt(n0, n1)
        if logw is None:
            new, lam = own, np.ones(len(own))
        else:
            parent = (deeper // 256 & ((1 << 8 * d) - 1)) * 256 + deeper % 256
            below = np.bincount(np.searchsorted(keys, parent), logw, len(keys))
            new = np.logaddexp(own, below) - np.log(2)
            lam = np.exp(own - np.log(2) - new)
        weights.append(lam)
        logw, deeper = new, keys
    p, rest, last = np.zeros((len(gram), 8)), np.ones((len(gram), 8)), np.full((len(gram), 8), np.nan)
    for (_, _, n0, n1, at), lam in zip(levels[::-1], weights[::-1]):
        est, seen = kt(n0, n1), (n0 + n1) > 0
        part = np.where(seen, lam, 0.0)[at]
        open_ = seen[at]
        p += np.where(open_, rest * part * est[at], 0.0)
        rest = np.where(open_, rest * (1 - part), rest)
        last = np.where(open_, est[at], last)
    some = ~np.isnan(last)
    return deeper, logw, np.where(some, p + rest * last, p), np.where(some, 0.0, rest)


def shallow(n1: np.ndarray, below: np.ndarray):
    """Depths 0 and 1 from counts (context byte, symbol) and sums of the depth-2 log P_w (context byte, node):
    per (context byte, node) the mixed part of P(bit = 1) and the weight left for depth 2."""
    c1 = np.zeros((256, 256, 2))
    for k in range(8):
        for bit in (0, 1):
            cols = np.flatnonzero(BITS[:, k] == bit)
            np.add.at(c1[:, :, bit].T, NODES[cols, k], n1[:, cols].T)
    own1 = log_kt(c1[..., 0], c1[..., 1])
    seen1 = c1.sum(-1) > 0
    own1[~seen1] = 0
    w1 = np.where(seen1, np.logaddexp(own1, below) - np.log(2), 0.0)
    lam1 = np.where(seen1, np.exp(own1 - np.log(2) - w1), 0.0)
    c0 = c1.sum(0)
    own0 = np.where(c0.sum(-1) > 0, log_kt(c0[..., 0], c0[..., 1]), 0.0)
    w0 = np.logaddexp(own0, w1.sum(0)) - np.log(2)
    lam0 = np.exp(own0 - np.log(2) - w0)[None, :]
    k0, k1 = kt(c0[..., 0], c0[..., 1])[None, :], kt(c1[..., 0], c1[..., 1])
    return lam0 * k0 + (1 - lam0) * lam1 * k1, (1 - lam0) * (1 - lam1), np.where(seen1, k1, k0 + 0 * k1)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, found = pd.factorize(np.concatenate(keys))
    return found, np.bincount(at, np.concatenate(counts), len(found))


def _counted(of_part, names: list[str], most: int = 2_000_000):
    """Keys of a partition's texts with their training counts, summed as far as memory goes."""
    def run(batches):
        keys, counts, size = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0].astype(np.int64))], names)
        for b in batches:
            for part in chunks(b):
                k, c = of_part(part, ~np.array(part.column("held_out").to_pylist(), bool))
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > 2 * most:
                    keys, counts = ([x] for x in _sums(keys, counts))
                    size = len(keys[0])
                    if size > most:
                        yield out()
                        keys, counts, size = [], [], 0
        if keys:
            keys, counts = ([x] for x in _sums(keys, counts))
            yield out()
    return run


def _part_words(part: pa.RecordBatch, learn: np.ndarray):
    """Hashes of the words with their training counts; the end token is 0."""
    row, _, _, h = words(*utf8(part.column("text")))
    found, c = _sums([h.view(np.int64)], [learn[row].astype(float)])
    return np.append(found, 0), np.append(c, float(learn.sum()))


def _part_grams(part: pa.RecordBatch, learn: np.ndarray):
    raw, offsets = utf8(part.column("text"))
    idx, gram = coded(raw, offsets, *words(raw, offsets)[:3])
    return _sums([gram], [learn[idx].astype(float)])


def coded(raw: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, six bytes) of every byte to code, in order; row, start and end are the texts' words."""
    n, size = len(offsets) - 1, end - start
    # each text: the padding, its words with closing spaces, the end token
    length = np.bincount(row, size + 1, n).astype(np.int64) + DEPTH + 1
    first = np.append(0, np.cumsum(length))
    out = np.full(first[-1], 32, np.uint8)
    out[first[1:] - 1] = 10
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[start] += 1
    np.add.at(solid, end, -1)
    data = lower_bytes(raw)[np.cumsum(solid[:-1]).astype(bool)]
    at = np.cumsum(size + 1) - (size + 1) + DEPTH + row * (DEPTH + 1)
    out[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
    gram = out.astype(np.int64)
    for d in range(1, DEPTH + 1):
        gram[DEPTH:] |= np.left_shift(out[DEPTH - d:len(out) - d], 8 * d, dtype=np.int64)
    idx = np.repeat(np.arange(n, dtype=np.int32), length)
    inside = np.ones(len(out), bool)
    inside[(first[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return idx[inside], gram[inside]


def _tree_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, logw, _, _ = subtree(pdf["gram"].to_numpy(), pdf["n"].to_numpy(float))
    return pd.DataFrame({"b1": (keys >> 8) & 255, "node": keys & 255, "logw": logw})


def _gram_scores(mixed: np.ndarray, left: np.ndarray, parent: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = pdf["gram"].to_numpy()
        _, _, p, rest = subtree(gram, pdf["n"].to_numpy(float))
        b1, symbol = (gram >> 8) & 255, gram & 255
        at = (b1[:, None], NODES[symbol])
        one = mixed[at] + left[at] * (p + rest * parent[at])
        one = np.clip(one, 1e-12, 1 - 1e-12)
        return pd.DataFrame({"gram": gram, "n": pdf["n"], "logp": np.log10(np.where(BITS[symbol] == 1, one, 1 - one)).sum(1)})
    return run


def frequent(df: DataFrame, by: str, top: int) -> DataFrame:
    """The most frequent rows, ``top`` at most: all above a count that a histogram of counts finds."""
    level = F.floor(F.log2(F.col(by).cast("double")) * 16).cast("int")
    steps = sorted(((r.k, r.n) for r in df.filter(F.col(by) > 0).groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in steps:
        if total + n > top:
            break
        total, least = total + n, k
    return df.filter(F.lit(False)) if least is None else df.filter((F.col(by) > 0) & (level >= least))


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, index of the value) by bisection."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (text, held_out): (h, c), every distinct word by hash with its training count, and (gram, n, logp), all six bytes with theirs and the last byte's log10 probability."""
    d = docs.select("text", "held_out")
    w = stage(d.mapInArrow(_counted(_part_words, ["h", "c"]), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "ctw-words")
    grams = stage(d.mapInArrow(_counted(_part_grams, ["gram", "n"]), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    near = F.shiftright("gram", 8).bitwiseAND(65_535)
    deep = grams.groupBy(near.alias("k")).applyInPandas(_tree_rows, "b1 long, node long, logw double")
    below, counts = np.zeros((256, 256)), np.zeros((256, 256))
    for r in deep.groupBy("b1", "node").agg(F.sum("logw").alias("v")).collect():
        below[r.b1, r.node] = r.v
    for r in grams.groupBy(F.shiftright("gram", 8).bitwiseAND(255).alias("b1"), F.col("gram").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).collect():
        counts[r.b1, r.s] = r.n
    return w, stage(grams.groupBy(near.alias("k")).applyInPandas(_gram_scores(*shallow(counts, below)), "gram long, n long, logp double"), "ctw-scores")


def _sorted_columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table as arrays, by the first one."""
    t = df.toArrow()
    cols = [t.column(c).to_numpy() for c in t.column_names]
    order = np.argsort(cols[0])
    return [c[order] for c in cols]


def _lists(row: np.ndarray, n: int, **cols: np.ndarray) -> pa.Array:
    off = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in cols.values()], list(cols)))


def _doc_rows(keys: np.ndarray, c: np.ndarray, grams: np.ndarray, logp: np.ndarray, end: int, total: int, distinct: int):
    base = lambda n: np.log10((n + 1.0) / (total + 1.0 * (distinct + 1)))

    def run(batches):
        for b in batches:
            for part in chunks(b):
                size = len(part)
                raw, offsets = utf8(part.column("text"))
                row, start, stop, h = words(raw, offsets)
                n = np.bincount(row, minlength=size) + 1
                ur, uh, k = per_row_unique(row, h.view(np.int64))
                ok, at = _lookup(keys, c, uh)
                per = lambda x: np.bincount(ur[ok], x, size) if ok.any() else np.zeros(size)
                known = per(k[ok] * (c[at[ok]] > 0) if ok.any() else None) + (end > 0)
                bs = per(k[ok] * base(c[at[ok]]) if ok.any() else None) + base(end)
                # frequent six bytes are looked up once per chunk, the others listed with their number of times
                idx, gram = coded(raw, offsets, row, start, stop)
                which, found = pd.factorize(gram)
                hit, place = _lookup(grams, logp, found)
                value = np.zeros(len(found))
                value[hit] = logp[place[hit]] if hit.any() else 0
                sc = np.bincount(idx, value[which], size)
                rest = ~hit[which]
                gr, g, gk = per_row_unique(idx[rest], gram[rest])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("key"), part.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.bincount(idx, minlength=size).astype(np.int64)),
                     pa.array(bs), pa.array(sc), _lists(ur[~ok], size, h=uh[~ok], k=k[~ok]), _lists(gr, size, gram=g, k=gk)],
                    ["rid", "key", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score", "rare", "grams"])
    return run


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row; learns where held_out is false."""
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    model, scored = train(d)
    total, distinct = (v or 0 for v in model.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    end = int(model.filter("h = 0").agg(F.sum("c")).first()[0] or 0)
    hot = _sorted_columns(frequent(model.filter("h <> 0"), "c", TOP).select("h", "c"))
    often = _sorted_columns(frequent(scored, "n", GRAMS).select("gram", "logp"))
    d = d.withColumn("rid", F.monotonically_increasing_id()).select("rid", "key", "held_out", "text")
    kind = d.schema["key"].dataType.simpleString()
    run = _doc_rows(*hot, *often, end, int(total), int(distinct))
    part = stage(d.mapInArrow(run, f"rid long, key {kind}, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double, rare array<struct<h:long,k:long>>, grams array<struct<gram:long,k:long>>"), "ctw-docs")
    base = F.log10((F.col("c") + 1.0) / (total + 1.0 * (distinct + 1)))
    rare = part.select("rid", F.explode("rare").alias("r")).select("rid", "r.h", "r.k").join(model, "h")
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("more_known"), F.sum(F.col("k") * base).alias("more_base"))
    seldom = part.select("rid", F.explode("grams").alias("r")).select("rid", "r.gram", "r.k").join(scored.select("gram", "logp"), "gram")
    seldom = seldom.groupBy("rid").agg(F.sum(F.col("k") * F.col("logp")).alias("more_score"))
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return part.drop("rare", "grams").join(rare, "rid", "left").join(seldom, "rid", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        add("base_score", "more_base").alias("base_score"), add("score", "more_score").alias("score"), "n_bytes",
        (-add("score", "more_score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
