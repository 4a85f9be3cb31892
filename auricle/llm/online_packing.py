"""Sum-of-squares online packing of token streams into windows.

Documents are placed one after the other, each into the fill level that leaves the smallest sum of squared
counts of partially filled windows. Only a level array is looked at: ``counts[h]`` windows hold ``h`` tokens.
Moving one window from level ``h`` to ``h + s`` changes the sum by ``2 counts[h + s] + 1`` (nothing for a full
window) and ``1 - 2 counts[h]`` (nothing for a new one), so one vector of levels decides. Ties go to the fullest
level. A document of a window or more fills whole windows first; its rest is placed like any other document.

Every task packs its own rows in one pass over the texts: no shuffle, and only open windows are held. When these
hold more than ``held`` tokens, and at the end of a task, they are settled: their pieces follow each other into full
windows and are cut at the borders. What is left at the end of a task is cut into windows of powers of two, which
need no padding. Packing is thus online within a task, and tasks know nothing of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
#: Window numbers of one task; the task's number stands above them.
TASK_BITS = 40
ROWS_OUT = 20_000
_NEVER = np.int64(2) ** 40


@dataclass(frozen=True)
class Settings:
    """``window``: tokens of a full window. ``held``: tokens that open windows hold before they are settled."""

    window: int = 4096
    held: int = 8_000_000

    def __post_init__(self):
        if self.window < 1 or self.held < 1:
            raise ValueError("sizes must be positive")


class Levels:
    """The level array: how many open windows hold how many tokens.

    Both arrays are kept by room left (``window - level``), so that the first minimum is the fullest level.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self._leave = np.full(window + 1, _NEVER)  # what taking a window from a level adds to the sum
        self._leave[window] = 0  # a new window leaves no level
        self._reach = np.ones(window + 1, np.int64)  # what a further window at a level adds
        self._reach[0] = 0  # a full one is closed

    def choose(self, size: int) -> int:
        """The level that a document of ``size`` tokens goes to; 0 opens a window."""
        change = self._leave[size:] + self._reach[: self.window + 1 - size]
        return self.window - size - int(change.argmin())

    def add(self, level: int, n: int) -> None:
        """``n`` more windows at a level; empty and full windows are not counted."""
        if 0 < level < self.window:
            self.counts[level] += n
            count, room = self.counts[level], self.window - level
            self._reach[room] = 2 * count + 1
            self._leave[room] = 1 - 2 * count if count else _NEVER

    @property
    def squares(self) -> int:
        return int((self.counts**2).sum())


#: A piece of an open window: document, start, document's tokens, ids.
Piece = tuple[int | None, int, int, np.ndarray]
Row = tuple[int | None, int, int, int, int, int, int]


class Packer:
    """Windows of one task. ``place`` and ``settle`` return the rows of windows that closed."""

    def __init__(self, settings: Settings, first: int = 0):
        self.window = settings.window
        self.levels = Levels(settings.window)
        self.open: dict[int, list[list[Piece]]] = {}
        self.next = first
        self.held = 0

    def _closed(self, pieces: list[Piece]) -> list[Row]:
        rows, offset = [], 0
        for doc, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((doc, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return rows

    def place(self, doc: int | None, ids: np.ndarray) -> list[Row]:
        """Place one document (at least one id)."""
        rows, total = [], len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            rows += self._closed([(doc, start, total, ids[start : start + self.window])])
        size = total - whole
        if not size:
            return rows
        level = self.levels.choose(size)
        pieces = self.open[level].pop() if level else []
        # A copy: a view would keep the ids of a whole slice of texts alive.
        pieces.append((doc, whole, total, ids[whole:].copy()))
        self.levels.add(level, -1)
        self.held += size
        if level + size == self.window:
            self.held -= self.window
            return rows + self._closed(pieces)
        self.levels.add(level + size, 1)
        self.open.setdefault(level + size, []).append(pieces)
        return rows

    def settle(self, last: bool) -> list[Row]:
        """Let the pieces of all open windows follow each other, the fullest windows first.

        The rest stays open, or is cut into powers of two when it is the ``last``.
        """
        left = self.held
        sizes = [self.window] * (left // self.window)
        left -= self.window * len(sizes)
        rest = [left] if left else []
        if last:
            rest = [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
        rows: list[Row] = []
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        stream = iter([piece for pieces in windows for piece in pieces])
        self.levels, self.open, self.held = Levels(self.window), {}, 0
        piece = None
        for size in [*sizes, *rest]:
            level, pieces = 0, []
            while level < size:
                doc, start, total, ids = piece or next(stream)
                taken, over = ids[: size - level], ids[size - level :]
                pieces.append((doc, start, total, taken))
                level += len(taken)
                piece = (doc, start + len(taken), total, over) if len(over) else None
            if size == self.window or last:
                rows += self._closed(pieces)
            else:
                self.levels.add(size, 1)
                self.open[size] = [pieces]
                self.held = size
        return rows


def _batch(rows: list[Row]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def pack(docs: DataFrame, path: str, settings: Settings | None = None, end_id: int = 2) -> DataFrame:
    """Pack whole documents (``doc_id``, ``text``) into windows: ids by the vocabulary at ``path``, then ``end_id``.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32`` (of its ids
    as little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (ids of its window before it).
    Every window is full, but for at most one of each power of two a task. A null or empty text is the end id
    alone; a null ``doc_id`` stays null; repeated rows are packed each on its own; a text of any length is cut
    where windows end; an empty table gives no rows; other columns are ignored. Which documents share a window
    depends on how the table is dealt to tasks, the ids in the windows do not.
    """
    settings = settings or Settings()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(settings, TaskContext.get().partitionId() << TASK_BITS)
        encode, rows = encoder(path), []
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encode(part.column("text"))
                flat = np.insert(ids, bounds[1:], end_id)
                ends = (bounds + np.arange(len(bounds))).tolist()
                for doc, start, end in zip(part.column("doc_id").to_pylist(), ends, ends[1:]):
                    rows += packer.place(doc, flat[start:end])
                    if packer.held > settings.held:
                        rows += packer.settle(last=False)
                if len(rows) >= ROWS_OUT:
                    yield _batch(rows)
                    rows = []
        rows += packer.settle(last=True)
        if rows:
            yield _batch(rows)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(packed, SCHEMA)


def padding(rows: DataFrame, window: int = 4096) -> DataFrame:
    """One row: ``sequences``, ``tokens``, ``padding`` (to ``window``; none for a power of two), ``pieces``, ``cut``
    (documents of at most one window that lie in more than one)."""
    filled = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces"))
    power = F.bit_count("n") == 1
    total = filled.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(~power, window - F.col("n")).otherwise(0)), F.lit(0)).alias("padding"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
    )
    cut = rows.agg(
        F.count_if((F.col("doc_tokens") <= window) & (F.col("start") == 0) & (F.col("length") < F.col("doc_tokens"))).alias(
            "cut"
        )
    )
    return total.crossJoin(F.broadcast(cut))
