"""Vector code compression: product quantisation in integers.

Vectors are cut into equal parts; each part has a codebook, and a part's code is the first of its nearest entries.
Everything is exact: distances come from dot products of integers that are broken into limbs, each pair of limbs is
one float64 matrix product whose sums stay below 2^53, and the products are recombined in int64. Entries become
``floor(sum / count)`` of their parts.

A round of training is one scan: a task adds up its rows by part and entry, Spark adds the tasks' sums, and the
driver sees one row per entry. Codebooks are bounded by their settings and go to the tasks as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..operators.ordered import small_side
from .common import materialize
from .hard_negatives import matrix

#: Rows whose distances to one codebook are held at once.
ROWS = 4096


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4

    def __post_init__(self):
        if self.parts < 1 or not 1 <= self.entries <= 1 << 16 or self.rounds < 0:
            raise ValueError("parts, entries (at most 65,536) and rounds must be positive")


def limbs(x: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """``x`` as n float64 limbs of ``bits`` bits, the lowest first; the highest one carries the sign."""
    out, mask = [], (np.int64(1) << bits) - 1
    for _ in range(n - 1):
        out.append((x & mask).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def limb_plan(width: int, most: int) -> tuple[int, int]:
    """(bits of a limb, limbs) so that sums of ``width`` products of limbs stay below 2^53."""
    bits = (53 - max(width, 1).bit_length()) // 2
    if bits < 1:
        raise ValueError(f"{width} components are too many for float64 sums")
    return bits, max(1, -(-int(most).bit_length() // bits))


def dot(a: np.ndarray, b: np.ndarray, bits: int, n: int) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exactly, if it fits int64."""
    out = np.zeros((len(a), len(b)), np.int64)
    left, right = limbs(a, bits, n), limbs(b, bits, n)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


@dataclass(frozen=True)
class Codebooks:
    """``entries``: parts x entries x components of a part."""

    entries: np.ndarray
    most: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first nearest entry, squared distance) of each row and part."""
        parts, _, size = self.entries.shape
        codes = np.zeros((len(vectors), parts), np.int64)
        errors = np.zeros((len(vectors), parts), np.int64)
        plan = limb_plan(size, self.most)
        for p, book in enumerate(self.entries):
            own = (book * book).sum(axis=1)
            for start in range(0, len(vectors), ROWS):
                rows = vectors[start : start + ROWS, p * size : (p + 1) * size]
                far = own - 2 * dot(rows, book, *plan)
                best = far.argmin(axis=1)
                codes[start : start + ROWS, p] = best
                errors[start : start + ROWS, p] = far[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
        return codes, errors

    def sha256(self) -> str:
        """Digest of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(table: DataFrame, books: Codebooks) -> list:
    """One row per used entry: part, entry, count and component sums over all rows."""
    parts, entries, size = books.entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, size), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = matrix(batch.column("vec"), books.width)
            codes, _ = books.assign(vectors)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(vectors[order, p * size : (p + 1) * size], first, axis=0)
                    counts[p, used] += np.diff([*first, len(order)])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry], pa.int64()),
                pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    rows = table.select("vec").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole).collect()


def prepare(rows: DataFrame) -> DataFrame:
    """Rows with a vector, written once: ``vec_id``, ``label``, ``vec`` (array of long without nulls)."""
    return materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "vec").where("vec IS NOT NULL"), "vectors")


def train(table: DataFrame, settings: Settings | None = None) -> Codebooks:
    """Codebooks of a prepared table. They start as the parts of the rows with the smallest ids, ascending (equal ids
    by components, null ids last); entries no part is nearest to stay. A table of fewer rows starts with one entry a
    row, an empty one gives codebooks without entries."""
    s = settings or Settings()
    size = table.agg(
        F.max(F.size("vec")).alias("width"),
        F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).alias("most"),
    ).first()
    part, most = -(-(size.width or 0) // s.parts), size.most or 0
    # Distances, and their sums over the parts, must fit a long.
    if 4 * most * most * part * s.parts >= 1 << 63:
        raise ValueError(f"components up to {most}: distances may leave the long range")
    first = table.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(s.entries).select("vec").toArrow()
    start = matrix(first.column("vec"), part * s.parts) if len(first) else np.zeros((0, part * s.parts), np.int64)
    books = Codebooks(start.reshape(len(start), s.parts, part).transpose(1, 0, 2).copy(), most)
    for _ in range(s.rounds if len(start) else 0):
        entries = books.entries.copy()
        for row in _sums(table, books):
            entries[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(part)]
        books = Codebooks(entries, most)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``codes`` (array of entry numbers in the order of parts) and ``error`` (squared distances over all parts)
    to a prepared table, in place of ``vec``."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assign(matrix(batch.column("vec"), books.width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(codes.tolist(), pa.list_(pa.int32())),
                    pa.array(errors.sum(axis=1), pa.int64()),
                ],
                names=["vec_id", "label", "codes", "error"],
            )

    schema = table.select("vec_id", "label").schema.add("codes", ArrayType(IntegerType())).add("error", "long")
    return table.select("vec_id", "label", "vec").mapInArrow(coded, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors that the codes stand for: each row's entries, one after the other."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = matrix(batch.column("codes"), books.entries.shape[0])
            vectors = np.concatenate([books.entries[p, codes[:, p]] for p in range(codes.shape[1])], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(vectors.tolist(), pa.list_(pa.int64()))], names=["vec_id", "vec"]
            )

    return coded.select("vec_id", "codes").mapInArrow(decoded, "vec_id long, vec array<long>")


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors summed over equal labels (null labels together). A label may hold any share
    of the rows: its errors are added up before they are shuffled, and the sums are broadcast if counted to be few."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compress(rows: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, Codebooks]:
    """(coded rows: ``vec_id, label, codes, error, label_error``, the codebooks they refer to).

    ``rows``: ``vec_id`` long, ``label`` of any type, ``vec`` array of long (see ``quantise``); a row without a
    vector is left out, one with a null id or label is coded like any other. Vectors whose length is not that of the
    longest, or no multiple of the parts, are padded with zeros. Repeated rows are coded alike, each as a row. An
    empty table gives no rows. Other columns are ignored. Distances that might leave the long range are an error.
    """
    table = prepare(rows)
    books = train(table, settings)
    return label_errors(materialize(encode(table, books), "codes")), books
