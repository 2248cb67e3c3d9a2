"""Hard-negative mining with exact scores from a residue-number-system matrix product.

Vectors become integers (each component scaled and rounded down). A block of
anchors and a block of rows are multiplied once per small prime: residues are
centred, so a product of SLICE components stays below 2^24 and float32 adds it
without error; wider vectors are multiplied in slices whose sums are reduced in
between. Chinese remaindering by mixed radix digits, centred too, gives back the
signed score; as many primes are taken as the largest possible score of the two
blocks needs.

1. ``positives``: anchors meet the rows of their own label. A label is cut into
   row blocks and anchor blocks of bounded size, so a label that holds a third
   of all rows is many tasks; each keeps its first few rows per anchor.
2. ``negatives``: all anchors, with the scores of their positives, meet all rows
   in blocks dealt by number. Only scores inside an anchor's windows leave the
   tile; each block keeps the first few per anchor and positive.

The blocks' firsts are merged by windows over one anchor.

Rows: those with a null label, a null vector or a null or non-finite component
take no part. Repeated rows are rows of their own, and so are rows of one id;
a row is never its own positive. A null id can be a positive or a negative (last
among ties), also an anchor if the caller's condition says so. Vectors of other
lengths, also empty ones, count as padded with zeros. Components must be below
2^31 once scaled and scores below 2^63, else the run ends with an error. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SLICE = 64
BLOCK = 8192
TILE = 1 << 20
SALTS = 32


def primes(least: int) -> list[int]:
    """The largest primes below 1024 whose product is above ``least`` (centred residues: at most 510, SLICE * 510^2 < 2^24)."""
    found: list[int] = []
    product = 1
    for n in range(1023, 2, -1):
        if product > least:
            break
        if all(n % k for k in range(2, int(n ** 0.5) + 1)):
            found.append(n)
            product *= n
    return found


def _centre(x: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, centred, of centred float32 residues: products of SLICE columns each, reduced in between."""
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, a.shape[1], SLICE):
        part = a[:, k:k + SLICE] @ b[:, k:k + SLICE].T
        total += part - np.float32(p) * np.rint(part / np.float32(p))
        total -= np.float32(p) * np.rint(total / np.float32(p))
    return total.astype(np.int64)


def moduli(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Primes enough for every inner product of integer rows of a and b."""
    if not a.size or not b.size:
        return []
    top_a, top_b = int(np.abs(a).max()), int(np.abs(b).max())
    if max(top_a, top_b) >= 1 << 31:
        raise ValueError("a scaled component reaches 2^31")
    most = min(int(np.abs(a).sum(axis=1).max()) * top_b, int(np.abs(b).sum(axis=1).max()) * top_a)
    if most >= 1 << 63:
        raise ValueError("scores may pass 2^63")
    return primes(2 * most + 1)


def residues(x: np.ndarray, by: list[int]) -> list[np.ndarray]:
    return [_centre(x, p).astype(np.float32) for p in by]


def scores(a: list[np.ndarray], b: list[np.ndarray], by: list[int]) -> np.ndarray:
    """The exact inner products, as int64, of the rows whose residues by the moduli ``by`` are given.

    Mixed radix: score = d0 + p0 * (d1 + p1 * (d2 + ...)) with centred digits."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(by):
        rest = _product(a[i], b[i], p)
        for q, d in zip(by[:i], digits):
            rest = _centre((rest - d) * pow(q, -1, p), p)
        digits.append(_centre(rest, p))
    out = np.zeros_like(digits[0])
    for p, d in zip(reversed(by), reversed(digits)):  # int64 may wrap on the way; the score fits, so the end is exact
        out = out * p + d
    return out


def tiles(a: np.ndarray, b: np.ndarray):
    """(slice of a's rows, their scores with all of b), about TILE scores at once."""
    wide = max(a.shape[1], b.shape[1], 1)
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    by = moduli(a, b)
    ra, rb = residues(a, by), residues(b, by)
    step = max(1, TILE // max(1, len(b)))
    for i in range(0, len(a) if by else 0, step):
        yield slice(i, i + step), scores([x[i:i + step] for x in ra], rb, by)


def _first(s: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k able entries of each row: higher first, ties by column."""
    row, col = np.nonzero(able)
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _best(s: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """able, less the entries that at least k others of their row surpass."""
    if s.shape[1] <= k:
        return able
    low = np.iinfo(np.int64).min
    bound = np.partition(np.where(able, s, low), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    above = able & (s > bound[:, None])
    tied = able & (s == bound[:, None])
    return above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1)[:, None]))


def _matrix(vectors: pd.Series) -> np.ndarray:
    rows = [np.frombuffer(v, np.int32) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _by_id(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["id", "uid"], na_position="last", kind="stable", ignore_index=True)


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """uid, id, label, anchor, v (int32 components) of the rows that take part, as a written table; rows: id, embedding, label, anchor."""
    def pack(batches):
        for b in batches:
            e = b.column("embedding")
            lists = e.cast(pa.large_list(pa.float64()))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat)
            with np.errstate(invalid="ignore", over="ignore"):
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                whole = np.floor(scale * x)
            keep = bad[offsets[1:]] == bad[offsets[:-1]]
            if e.null_count:
                keep &= ~np.asarray(e.is_null())
            keep &= ~np.asarray(b.column("label").is_null())
            used = np.repeat(keep, np.diff(offsets))
            at = x[offsets[0]:offsets[-1]], whole[offsets[0]:offsets[-1]]
            if np.any(np.abs(at[1][used]) >= 1 << 31):
                raise ValueError("a scaled component reaches 2^31")
            fixed = np.where(used, at[1], 0).astype("<i4").tobytes()
            o = 4 * (offsets - offsets[0])
            v = pa.array([fixed[i:j] for i, j in zip(o[:-1], o[1:])], pa.binary())
            table = pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("label").cast(pa.int64()), b.column("anchor"), v], ["uid", "id", "label", "anchor", "v"])
            yield table.filter(pa.array(keep))
    named = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"), "embedding", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    return stage(named.mapInArrow(pack, "uid long, id long, label long, anchor boolean, v binary"), "residues")


def _dealt(rows: DataFrame, parts: DataFrame, own: str, other: str) -> DataFrame:
    """rows with block (own, by hash) and every block of the other side; parts: label, own, other counts; salted, as one label may hold most rows."""
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"])
    mine = F.pmod(F.xxhash64("uid", F.lit(1)), F.col(f"n_{own}")).alias(own)
    return r.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("salt", "n_a", "n_r")


def positives(rows: DataFrame, k: int) -> DataFrame:
    """uid, label, v, found: each anchor with its first k other rows of its label (structs score, uid, id), best first."""
    def blocks(flag: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(flag, 1).otherwise(0)) / F.lit(BLOCK)), F.lit(1))
    parts = rows.groupBy("label").agg(blocks(F.col("anchor")).alias("n_a"), blocks(F.lit(True)).alias("n_r"), F.max("anchor").alias("any")).filter("any").drop("any")
    a = _dealt(rows.filter("anchor").select("uid", "label", "v"), parts, "a", "r")
    r = _dealt(rows.select("uid", "id", "label", "v"), parts, "r", "a")
    r = r.toDF(*r.columns)  # names of its own, as both sides come from one table

    def near(pdf_a: pd.DataFrame, pdf_r: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf_r = _by_id(pdf_r)
        va, vr = _matrix(pdf_a["v"]), _matrix(pdf_r["v"])
        ua, ur = pdf_a["uid"].to_numpy(), pdf_r["uid"].to_numpy()
        for at, s in tiles(va, vr):
            able = ua[at, None] != ur[None, :]
            row, col = _first(s, _best(s, able, k), k)
            out.append(pd.DataFrame({"anchor_uid": ua[at][row], "score": s[row, col], "uid": ur[col], "id": pdf_r["id"].iloc[col].astype("Int64").to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_uid": [], "score": [], "uid": [], "id": []}, dtype="Int64")
    found = a.groupBy("label", "a", "r").cogroup(r.groupBy("label", "a", "r")).applyInPandas(near, "anchor_uid long, score long, uid long, id long")
    best = Window.partitionBy("anchor_uid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    lists = top.groupBy(F.col("anchor_uid").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("found"))
    return rows.filter("anchor").select("uid", F.col("id").alias("anchor_id"), "label", "v").join(lists, "uid")


def negatives(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: per anchor and positive the first k rows of
    another label whose score is from low to high percent of the positive's."""
    n_a = max(1, -(-anchors.count() // BLOCK))
    n_r = max(1, -(-rows.count() // BLOCK))

    def dealt(t: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # Both numbers as long on either side: int and long keys of one value hash to different partitions.
        mine = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(n)).cast("long")
        return t.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    a = dealt(anchors.select("uid", "label", "v", F.transform("found", lambda x: x["score"]).alias("scores")), "a", n_a, "r", n_r)
    r = dealt(rows.select("uid", "id", "label", "v"), "r", n_r, "a", n_a)
    r = r.toDF(*r.columns)

    def window(pdf_a: pd.DataFrame, pdf_r: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf_r = _by_id(pdf_r)
        va, vr = _matrix(pdf_a["v"]), _matrix(pdf_r["v"])
        la, lr = pdf_a["label"].to_numpy(), pdf_r["label"].to_numpy()
        ua = pdf_a["uid"].to_numpy()
        n = pdf_a["scores"].map(len).to_numpy() if len(pdf_a) else np.zeros(0, int)
        wide = int(n.max()) if len(n) else 0
        lo, hi = np.ones((len(ua), wide), np.int64), np.zeros((len(ua), wide), np.int64)
        for i, found in enumerate(pdf_a["scores"]):  # whole scores s with low * p <= 100 * s <= high * p, worked out in Python's integers
            lo[i, :n[i]] = [-(-low * int(p) // 100) for p in found]
            hi[i, :n[i]] = [high * int(p) // 100 for p in found]
        some = lo <= hi
        least = np.where(some, lo, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        most = np.where(some, hi, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
        for at, s in tiles(va, vr):
            able = (la[at, None] != lr[None, :]) & (s >= least[at, None]) & (s <= most[at, None])
            row, col = _first(s, able, len(lr))
            value = s[row, col]
            for j in range(wide):
                fits = (value >= lo[at][row, j]) & (value <= hi[at][row, j])
                rj, cj, vj = row[fits], col[fits], value[fits]
                first = np.arange(len(rj)) - np.searchsorted(rj, rj) < k
                out.append(pd.DataFrame({"uid": ua[at][rj[first]], "nth": j, "score": vj[first], "id": pdf_r["id"].iloc[cj[first]].astype("Int64").to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"uid": [], "nth": [], "score": [], "id": []}, dtype="Int64")
    found = a.groupBy("a", "r").cogroup(r.groupBy("a", "r")).applyInPandas(window, "uid long, nth int, score long, id long")
    best = Window.partitionBy("uid", "nth").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(anchors.select("uid", "anchor_id", "found"), "uid").select(
        "anchor_id", F.get("found", F.col("nth"))["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.get("found", F.col("nth"))["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def mine(rows: DataFrame, anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows (vec_id, embedding, label) that meet ``anchor``; the columns are those of ``negatives``."""
    whole = integers(rows.select(F.col("vec_id").alias("id"), "embedding", "label", anchor.alias("anchor")), scale)
    return negatives(stage(positives(whole, n_positives), "positives"), whole, n_negatives, low, high)
