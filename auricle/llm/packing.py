"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared piece
lengths, what block-diagonal attention pays). A piece demands ``(length, 1, length ** 2)``, so pieces of one
length are interchangeable, and so are sequences with equal residual capacities. Best fit therefore runs on
classes: pieces in falling length, each class placed into the feasible residual class that scores best.

* ``norm``: the smallest weighted norm of the residual capacities after placing. A sequence that took a piece
  is the tightest one for the next piece of that length, so it is filled with them at once.
* ``dot``: the largest weighted dot product of demand and residual. A placed piece lowers the product, so one
  piece goes to every sequence of the class in turn.

Both give exactly what placing the pieces one by one would give. The driver sees one count per length, at most
``tokens`` of them, whatever the number of documents; the plan it makes is a list of runs (length, first rank,
first sequence, pieces per sequence, offset). Each piece finds its run by its rank within its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, materialize, slices
from .tokens import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS_PER_BUCKET = 200_000


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds; ``weights`` of tokens, documents and attention cost in the score."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule!r}")
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("capacities must be positive")

    @property
    def longest(self) -> int:
        """The longest piece that an empty sequence takes."""
        return min(self.tokens, int(self.attention**0.5))


def cut_pieces(docs: DataFrame, path: str, longest: int, end_id: int = 0) -> DataFrame:
    """Token pieces of whole documents: ids by the vocabulary at ``path``, then ``end_id``.

    Only a document of more than ``longest`` ids is cut. A null text is empty, so it is one piece of one id.
    """

    def pieces(batches):
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encode(part.column("text"))
                sizes = np.diff(bounds) + 1
                n = -(-sizes // longest)
                row = np.repeat(np.arange(len(sizes)), n)
                index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = index * longest
                length = np.minimum(longest, sizes[row] - start)
                flat = np.full(int(sizes.sum()), end_id, "<u4")
                at = np.cumsum(sizes) - sizes
                spot = np.ones(len(flat), bool)
                spot[at + sizes - 1] = False
                flat[spot] = ids
                raw = memoryview(flat.tobytes())
                places = (at[row] + start) * 4
                crc = [zlib.crc32(raw[p : p + 4 * k]) for p, k in zip(places.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(index, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(pieces, PIECE_SCHEMA)


class _Classes:
    """Open sequences by residual capacities, as runs of sequence numbers."""

    def __init__(self, caps: Capacities):
        self.caps = np.array([caps.tokens, caps.documents, caps.attention], np.int64)
        self.weights = np.array(caps.weights)
        self.rule = caps.rule
        self.rows = np.zeros((1024, 3), np.int64)
        self.used = 0
        self.runs: list[list[tuple[int, int]]] = []
        self.place: dict[tuple[int, int, int], int] = {}

    def best(self, demand: np.ndarray) -> int:
        rows = self.rows[: self.used]
        fits = np.flatnonzero((rows >= demand).all(axis=1))
        if not len(fits):
            return -1
        if self.rule == "norm":
            rest = (rows[fits] - demand) / self.caps
            return int(fits[np.argmin((rest * rest) @ self.weights)])
        return int(fits[np.argmax((rows[fits] / self.caps) @ (self.weights * demand / self.caps))])

    def add(self, residual: np.ndarray, runs: list[tuple[int, int]]) -> None:
        key = tuple(residual.tolist())
        if not runs or key[0] < 1 or key[1] < 1 or key[2] < 1:
            return
        at = self.place.get(key)
        if at is None:
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            at = self.place[key] = self.used
            self.rows[at] = residual
            self.runs.append([])
            self.used += 1
        self.runs[at].extend(runs)

    def drop(self, at: int) -> None:
        """Forget a class; the last one moves to its place."""
        del self.place[tuple(self.rows[at].tolist())]
        self.used -= 1
        last = self.runs.pop()
        if at != self.used:
            self.rows[at] = self.rows[self.used]
            self.runs[at] = last
            self.place[tuple(self.rows[at].tolist())] = at

    def take(self, at: int, n: int) -> list[tuple[int, int]]:
        """The first ``n`` sequences of a class, or all of it."""
        out, runs = [], self.runs[at]
        while n and runs:
            first, size = runs.pop()
            k = min(n, size)
            out.append((first, k))
            if k < size:
                runs.append((first + k, size - k))
            n -= k
        if not runs:
            self.drop(at)
        return out


def best_fit(counts: dict[int, int], caps: Capacities) -> pd.DataFrame:
    """The plan for ``counts`` pieces of each length: runs of ``pieces`` pieces from ``rank`` on, ``per`` in each
    sequence from ``sequence`` on, the first of them at ``offset``."""
    classes, plan, opened = _Classes(caps), [], 0

    def put(length: int, rank: int, runs, per: int, residual: np.ndarray, demand: np.ndarray) -> int:
        offset = int(classes.caps[0] - residual[0])
        for first, n in runs:
            plan.append((length, rank, n * per, first, per, offset))
            rank += n * per
        classes.add(residual - per * demand, runs)
        return rank

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > classes.caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            at = classes.best(demand)
            fresh = at < 0
            residual = classes.caps.copy() if fresh else classes.rows[at].copy()
            stack = int((residual // demand).min()) if fresh or caps.rule == "norm" else 1
            if fresh and caps.rule == "dot":
                stack = 1
            per = min(stack, left)
            # New sequences open one by one under "dot": the next piece may prefer one just opened.
            wanted = 1 if fresh and caps.rule == "dot" else left // per
            if fresh:
                runs, opened = [(opened, wanted)], opened + wanted
            else:
                runs = classes.take(at, wanted)
            before = rank
            rank = put(length, rank, runs, per, residual, demand)
            left -= rank - before
    return pd.DataFrame(plan, columns=["length", "rank", "pieces", "sequence", "per", "offset"])


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, the place of a piece among those of its length; no task holds a whole length."""
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("place") - 1)
        .drop("bucket", "place", "first")
    )


def place(pieces: DataFrame, caps: Capacities) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length``.

    ``pieces`` is read several times, so it must be a written table or cheap and stable.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, caps).sort_values(["length", "rank"])
    at_length, at_rank, sequence, per, offset = (
        plan[c].to_numpy() for c in ("length", "rank", "sequence", "per", "offset")
    )
    step = np.int64(2) ** 44
    keys = at_length * step + at_rank

    def find(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(keys, length * step + rank, "right") - 1
            inside = rank - at_rank[run]
            where = sequence[run] + inside // per[run]
            begin = offset[run] + inside % per[run] * length
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(where, pa.int64()), pa.array(begin, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    rows = ranked(pieces, sum(counts.values()))
    schema = rows.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(find, schema)


def pack(docs: DataFrame, path: str, caps: Capacities | None = None, end_id: int = 0) -> DataFrame:
    """Pack whole documents (``doc_id``, ``text``) into sequences.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null or empty texts are
    one piece holding the end id; a null ``doc_id`` is kept as null; repeated rows are packed each on its own;
    an empty table gives no rows; other columns are ignored. Ties go to the class that was opened first.
    """
    caps = caps or Capacities()
    pieces = materialize(cut_pieces(docs, path, caps.longest, end_id), "pieces", TEXTS_PER_BATCH)
    return place(pieces, caps).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
