"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics of the whole text are standardised and mapped to random
cosines, whose inner products approximate a Gaussian kernel. Each partition
sums its part of the normal equations per fold; the sums (features squared,
three folds) are all that reaches the driver. The ridge weight of a fold is
solved without that fold, so the out-of-fold scores of the training rows
choose the penalty and feed the calibration: an isotonic fit over a fixed
grid of score bins.

Null and empty texts are scored like a text without words. Labels other than
0 and 1 and unlabelled rows are not learned from; several labels of one
document count as their largest. Without training rows of both kinds every
score is the share of ones (0.5 without rows). Repeated rows each count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, lower_bytes, per_row_unique, stage, utf8, words

FOURIER, WIDTH, SEED, BINS, FOLDS = 256, 6.0, 11, 2000, 3
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 bar, 7 exclamation, 8 other mark, 9 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 9
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 8
_KIND[[0x20, *range(9, 14)]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[ord("|")], _KIND[ord("!")] = 6, 7
NAMES = 9 + 16


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, NAMES) statistics of the texts."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per = lambda row, weights=None: np.bincount(row, weights, n)
    at = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(at * 10 + _KIND[raw], minlength=n * 10).reshape(n, 10)[:, 1:] / np.maximum(size, 1)[:, None]
    row, start, end, h = words(raw, offsets)
    w = per(row)
    safe = np.maximum(w, 1)
    length = (end - start).astype(float)
    mean = per(row, length) / safe
    sd = np.sqrt(np.maximum(per(row, length ** 2) / safe - mean ** 2, 0))
    urow, _, c = per_row_unique(row, h)
    top = np.zeros(n)
    np.maximum.at(top, urow, c / safe[urow])
    entropy = -per(urow, c / safe[urow] * np.log2(c / safe[urow]))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair, _, pc = per_row_unique(row[1:][row[1:] == row[:-1]], (h[:-1] * np.uint64(3) + h[1:])[row[1:] == row[:-1]])
    first, last = _KIND[raw[start]] if len(raw) else start, _KIND[raw[end - 1]] if len(raw) else start
    line = (raw == 10)
    lines = per(at[line]) + 1
    # lines by the hash of their bytes
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(line) + 1]))
    cut = cut[cut < len(raw)]
    lrow = np.searchsorted(offsets, cut, "right") - 1
    low = lower_bytes(raw).astype(np.uint64)
    up = (np.arange(len(raw), dtype=np.uint64) - np.repeat(cut, np.diff(np.append(cut, len(raw)))).astype(np.uint64)) if len(cut) else low
    lh = np.add.reduceat((low + np.uint64(1)) * (up * np.uint64(0x9E3779B97F4A7C13) + np.uint64(0x632BE59BD9B4E019)), cut) if len(cut) else low[:0]
    dl, _, dc = per_row_unique(lrow, lh)
    cols = [np.log1p(size), np.log1p(w), mean, sd, per(urow) / safe, top, entropy, per(row[same]) / safe,
            per(pair) / np.maximum(per(pair, pc.astype(float)), 1), per(row[first == 2]) / safe, per(row[last >= 5]) / safe,
            per(row[last >= 6]) / safe, per(row[length == 1]) / safe, np.log1p(size / lines), per(dl) / np.maximum(per(dl, dc.astype(float)), 1), per(row[length > 20]) / safe]
    return np.column_stack([share, *cols]).astype(np.float32)


def _features(keys: list[str]):
    def run(batches):
        for b in batches:
            got = [statistics(*utf8(part.column("text"))) for part in chunks(b)]
            x = np.concatenate(got) if got else np.zeros((0, NAMES), np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), NAMES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), flat], [*keys, "x"])
    return run


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    d = docs.select(*keep, F.col(text).alias("text"))
    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(_features(keep), f"{fields}, x array<float>")


class Model:
    """Standardisation, cosines, ridge weights and the calibration steps."""

    def __init__(self, mean, sd, fourier: int = FOURIER, width: float = WIDTH, seed: int = SEED):
        rng = np.random.RandomState(seed)
        self.mean, self.sd = np.asarray(mean, float), np.maximum(np.asarray(sd, float), 1e-6)
        self.w, self.b = rng.normal(0, 1 / width, (len(self.mean), fourier)), rng.uniform(0, 2 * np.pi, fourier)
        self.weights: np.ndarray | None = None
        self.share, self.grid = 0.5, None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(z))])

    def calibrated(self, s: np.ndarray) -> np.ndarray:
        if self.grid is None:
            return np.full(len(s), self.share)
        return np.interp(s, *self.grid)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: (bin centres, fitted means)."""
    blocks: list[list[float]] = []  # weight, sum of y, sum of x, bins
    for xi, yi, ni in zip(x, y, n):
        blocks.append([ni, yi, xi * ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _equations(model: Model):
    def run(batches):
        size = len(model.b) + 1
        total = {f: np.zeros((size, size + 1)) for f in range(FOLDS)}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(len(b), -1)
            y, f = np.array(b.column("y").to_pylist(), float), np.array(b.column("part").to_pylist())
            for at in range(0, len(x), 4096):
                z = model.map(x[at:at + 4096])
                for k in range(FOLDS):
                    zk = z[f[at:at + 4096] == k]
                    total[k] += zk.T @ np.column_stack([zk, y[at:at + 4096][f[at:at + 4096] == k]])
        rows = [(k, i, r.tolist()) for k, m in total.items() if m.any() for i, r in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["part", "i", "v"])
    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})


def fit(train: DataFrame) -> Model:
    """train: x array<float>, y double 0/1, part int fold."""
    spots = [c for i in range(NAMES) for c in (F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]))]
    row = train.agg(F.count("*"), F.avg("y"), *spots).first()
    model = Model([v or 0.0 for v in row[2::2]], [v or 0.0 for v in row[3::2]])
    if not row[0] or row[1] in (0.0, 1.0):
        model.share = 0.5 if not row[0] else float(row[1])
        return model
    sums = train.mapInArrow(_equations(model), "part int, i int, v array<double>").groupBy("part", "i").applyInPandas(_add, "part int, i int, v array<double>")
    size = len(model.b) + 1
    eq = np.zeros((FOLDS, size, size + 1))
    for r in sums.collect():
        eq[r.part, r.i] = r.v
    whole = eq.sum(0)
    ones = float(row[0]) * float(row[1])  # sum of y squared, for labels 0 and 1
    solve = lambda m, lam: np.linalg.solve(m[:, :-1] + lam * max(m[-1, -2], 1.0) * np.eye(size) / size, m[:, -1])
    best = None
    for lam in PENALTIES:
        ws = [solve(whole - eq[k], lam) for k in range(FOLDS)]
        loss = ones + sum(w @ eq[k][:, :-1] @ w - 2 * w @ eq[k][:, -1] for k, w in enumerate(ws))
        if best is None or loss < best[0]:
            best = (loss, lam, ws)
    model.weights = solve(whole, best[1])
    bins = train.mapInArrow(_out_of_fold(model, np.stack(best[2])), "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    x = (np.array([b.bin for b in bins]) + 0.5) / BINS * 3 - 1
    model.grid = isotonic(x, np.array([b.y for b in bins]), np.array([b.n for b in bins]))
    return model


def _out_of_fold(model: Model, ws: np.ndarray):
    """Counts and label sums per bin of the score from -1 to 2."""
    def run(batches):
        n, y = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(len(b), -1)
            part, label = np.array(b.column("part").to_pylist(), int), np.array(b.column("y").to_pylist(), float)
            s = np.concatenate([(model.map(x[at:at + 4096]) * ws[part[at:at + 4096]]).sum(1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            k = np.clip(((s + 1) / 3 * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(k, minlength=BINS)
            y += np.bincount(k, label, BINS)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k]), pa.array(y[k])], ["bin", "n", "y"])
    return run


def _score(model: Model, keys: list[str]):
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(len(b), -1)
            parts = [model.calibrated(model.map(x[at:at + 4096]) @ model.weights if model.weights is not None else np.zeros(len(x[at:at + 4096]))) for at in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*keys, "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted; learns from rows whose fold 3 remainder is not 1."""
    x = stage(features(docs.select(F.col(key).alias("key"), (fold(F.col(key), 3) == 1).alias("held_out"), F.col(text).alias("text")), ["key", "held_out"]), "quality")
    y = labels.filter("quality in (0, 1)").groupBy(F.col(key).alias("key")).agg(F.max("quality").cast("double").alias("y"))
    part = (F.pmod(F.xxhash64("key"), F.lit(FOLDS))).cast("int").alias("part")
    train = stage(x.filter(~F.col("held_out")).join(y, "key").select("x", "y", part), "quality-train")
    model = fit(train)
    fields = f"key {x.schema['key'].dataType.simpleString()}, held_out boolean, score double"
    out = x.mapInArrow(_score(model, ["key", "held_out"]), fields)
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
