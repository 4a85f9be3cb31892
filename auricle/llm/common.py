"""What several operators share: written tables, Arrow slices of texts, word hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, lower-cased in A-Z only. A word is
known by a 64-bit hash: a polynomial over its bytes, taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)  # fixed values
WORD = r"[^\x20\x09-\x0D]+"  # fixed value
SLICE_BYTES = 2_000_000
#: Whole texts in an Arrow batch: a batch is held by the JVM and, with the one before, by a Python worker.
TEXTS_PER_BATCH = 1_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256), SPACES)
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C13)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What is written inside goes to Python in batches of at most so many rows; the session's own limit if None."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    if rows is not None and not 0 < int(before) < rows:
        spark.conf.set(limit, str(rows))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write the rows below the shared checkpoint folder and read them back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def fenced(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows that pass, where the optimizer must not move conditions below what computes the columns.

    A condition pushed through a projection (also one inferred from an explode or a join) is evaluated there a
    second time, with every column written out; with expressions over whole texts that multiplies the work.
    """
    kept = F.col("_fence") >= 0
    marked = df.withColumn("_fence", F.monotonically_increasing_id())
    return marked.where(kept if condition is None else kept & condition).drop("_fence")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _R if which == "up" else _R_INV, np.uint64)
        base[0] = 1
        _powers[which] = np.cumprod(base, dtype=np.uint64)
    return _powers[which]


def raw_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes; a longer text is a piece of its own."""
    if not len(batch):
        return
    _, offsets = raw_utf8(batch.column(column))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, len(batch))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a slice of texts.

    ``hashes``: one 64-bit hash per word in text order; ``bounds``: n + 1 positions, words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``; ``starts`` / ``ends``: byte places in ``data``. ``table`` maps each
    byte first; by default it lower-cases A-Z.
    """

    def __init__(self, texts: pa.Array, table: bytes = LOWER):
        raw, offsets = raw_utf8(texts)
        data = np.frombuffer(raw.tobytes().translate(table), np.uint8)
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        before &= ~first[:n]
        after &= ~first[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", n + 1)[:n], out=sums[1:])
        raw_hash = (sums[self.ends] - sums[self.starts]) * _power("down", n + 1)[self.starts]
        self.hashes = mix(raw_hash + (self.ends - self.starts).astype(np.uint64))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.sums = sums

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all runs of ``size`` bytes inside words, the byte place of each)."""
        per_word = np.maximum(self.ends - self.starts - size + 1, 0)
        at = np.repeat(self.starts, per_word) + ragged(per_word)
        raw = (self.sums[at + size] - self.sums[at]) * _power("down", len(self.data) + 1)[at]
        return mix(raw + np.uint64(size << 32)), at

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the first ``size`` bytes of longer words, the byte place of each)."""
        at = self.starts[self.ends - self.starts > size]
        raw = (self.sums[at + size] - self.sums[at]) * _power("down", len(self.data) + 1)[at]
        return mix(raw + np.uint64(size << 40)), at

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
