"""Shared helpers: tables, staging in the shared folder, batch kernels over UTF-8 bytes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at once by the numpy kernels.
CHUNK = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C13  # 3 mod 8, so neighbouring letters that swap change the sum
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a new one only where the session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        import tempfile
        path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once below the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = (np.full(size, v, np.uint64) for v in (_BASE, _INV))
        up[0] = down[0] = 1
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text"):
    """Slices of a batch with about CHUNK bytes of text each (one row at least)."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, 64-bit hash) of every word of the lower-cased texts, in order."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    solid = ~SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw]] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return row, start, end, mix(h + (end - start).astype(np.uint64))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def per_row_unique(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, with counts."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))
