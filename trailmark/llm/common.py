"""Helpers that the operators share: settled frames, table reads, words and hashes of whole Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.lineage import shared_folder, spent

#: A word is a run of characters other than these (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set as the checkpoint folder where there is none yet."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint in the shared folder. What was shuffled for it is removed."""
    shared_dir(df.sparkSession)
    return spent(df).checkpoint()


#: Rows of ids up to which a list is broadcast (some 100 MB); longer ones are joined by shuffling.
BROADCAST_IDS = 2_000_000


def sent_if_small(ids: DataFrame) -> DataFrame:
    """A settled list of ids with the hint to broadcast it, if it is short."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def word_count(text) -> F.Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(column, n: int) -> F.Column:
    """crc32 of the column's text, modulo ``n``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a pyarrow string column laid end to end, and the bounds of its rows (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_blocks(bounds: np.ndarray, most: int):
    """Ranges of rows whose bytes come to about ``most``; a longer row stands alone."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(bounds) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the rows, in order."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins = ~gap[1:-1] & gap[:-2]
    begins[inner] |= ~gap[1:-1][inner]
    ends = ~gap[1:-1] & gap[2:]
    ends[inner - 1] |= ~gap[1:-1][inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running polynomial sum modulo 2^64."""
    power = _powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    back = _powers(_BACK, len(data))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
