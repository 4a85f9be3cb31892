"""Files read by ranges: content hashes of any size, array files, manifests found by a pattern.

Spark lists the files; tasks open them through Arrow's file systems (local and shared folders, and the stores that
the installed Arrow knows by their scheme), and hold a range at a time, never a file.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import DataContractError
from ..operators.curation import union_manifests
from .readers import MEDIA_SUFFIXES

CHUNK_BYTES = 8 << 20
RANGE_BYTES = 64 << 20
HEADER_BYTES = 1 << 20


def open_file(path: str):
    """A file to be read from any position; ``file:`` paths and plain ones are local or mounted."""
    path = re.sub("^file:/+", "/", path)
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path`` and ``size_bytes`` of the files below ``path`` (or that it matches), empty ones included.

    The names are those of Spark's own file index, which the driver holds; sizes are asked for in tasks, no content is
    read. A file that cannot be opened has no size.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = [(unquote(p),) for p in reader.load(path).inputFiles()]
    parts = max(1, min(len(names), spark.sparkContext.defaultParallelism))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_size_of(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "size_bytes"])

    rows = spark.createDataFrame(names, "path string").repartition(parts)
    return rows.mapInArrow(sized, "path string, size_bytes bigint")


def _size_of(path: str) -> int | None:
    try:
        with open_file(path) as f:
            return f.size()
    except OSError:
        return None


def sha256_of(path: str, chunk: int = CHUNK_BYTES) -> str:
    """Hex digest of a file, ``chunk`` bytes at a time."""
    digest = hashlib.sha256()
    with open_file(path) as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def inventory(spark: SparkSession, path: str, suffixes: Sequence[str] = MEDIA_SUFFIXES, tasks: int | None = None) -> DataFrame:
    """Path, name, size and SHA-256 of the matching files below ``path``; files may be of any size.

    Files are dealt to ``tasks`` tasks (by default those of the cluster's parallelism) by a hash of their path. A file
    that vanished or cannot be opened has a null digest and its ``error``.
    """
    files = list_files(spark, path, "*.{" + ",".join(suffixes) + "}")
    dealt = files.repartition(tasks or max(1, spark.sparkContext.defaultParallelism), "path")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, errors = [], []
            for name in batch.column("path").to_pylist():
                try:
                    digest, error = sha256_of(name), None
                except OSError as e:
                    digest, error = None, str(e)
                digests.append(digest)
                errors.append(error)
            out = [*batch.columns, pa.array(digests, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["path", "size_bytes", "sha256", "error"])

    rows = dealt.mapInArrow(hashed, "path string, size_bytes bigint, sha256 string, error string")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "sha256", "error")


# --- array files


def array_header(path: str) -> tuple[int, np.dtype, bool, tuple[int, ...]]:
    """(where the values begin, their type, column-major, shape) of an array file."""
    form = np.lib.format
    with open_file(path) as raw:
        f = io.BytesIO(raw.read(HEADER_BYTES))
        version = form.read_magic(f)
        read = form.read_array_header_1_0 if version == (1, 0) else form.read_array_header_2_0
        shape, column_major, dtype = read(f)
        begin = f.tell()
        if dtype.kind not in "fiub" or (dtype.kind == "u" and dtype.itemsize == 8):
            raise DataContractError(f"{path}: values of type {dtype} cannot be read")
        values = int(np.prod(shape, dtype=np.int64))
        if begin + values * dtype.itemsize > raw.size():
            raise DataContractError(f"{path}: the file ends before its {values} values")
    return begin, dtype, column_major, shape


def read_rows(path: str, begin: int, dtype: np.dtype, column_major: bool, shape: Sequence[int], first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last`` of the array, each flattened in row order; reads no more than those rows."""
    n, inner = shape[0], [int(x) for x in shape[1:]]
    width = int(np.prod(inner, dtype=np.int64))
    with open_file(path) as f:
        if not column_major or not inner:
            raw = f.read_at((last - first) * width * dtype.itemsize, begin + first * width * dtype.itemsize)
            return np.frombuffer(raw, dtype).reshape(last - first, width)
        # Values of one column lie together: one run of each column.
        columns = np.empty((width, last - first), dtype)
        for c in range(width):
            raw = f.read_at((last - first) * dtype.itemsize, begin + (c * n + first) * dtype.itemsize)
            columns[c] = np.frombuffer(raw, dtype)
    whole = columns.reshape([*inner[::-1], last - first])  # column-major places, the last one slowest
    return np.ascontiguousarray(whole.transpose(range(len(inner), -1, -1))).reshape(last - first, width)


ELEMENTS = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_RANGE = "path string, begin bigint, dtype string, column_major boolean, shape array<bigint>, first bigint, last bigint"


def read_array_files(
    spark: SparkSession, path: str, element: str = "float", pattern: str = "*.npy", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Rows of array files: ``path``, ``row`` (from 0), ``shape`` of a row, ``values`` flattened in row order.

    The headers are parsed in tasks, each file is dealt out in row ranges of about ``range_bytes``, and a range is read
    from the file at its position: no task holds a file. Any real type, byte order and element order is read, as
    ``element``; a number by itself is an array of one row. A type that is no number, a file cut short or one that is
    no array file is an error.
    """
    if element not in ELEMENTS:
        raise ValueError(f"unknown element type {element!r}")
    files = list_files(spark, path, pattern)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column("path").to_pylist():
                begin, dtype, column_major, shape = array_header(name)
                shape = list(shape) or [1]
                size = max(1, int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize)
                step = max(1, range_bytes // size)
                for first in range(0, shape[0], step):
                    out.append((name, begin, dtype.str, column_major, shape, first, min(first + step, shape[0])))
            columns = zip(*out) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            names = ["path", "begin", "dtype", "column_major", "shape", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dtype = np.dtype(r["dtype"])
                size = max(1, int(np.prod(r["shape"][1:], dtype=np.int64)) * max(dtype.itemsize, 8))
                step = max(1, CHUNK_BYTES // size)
                for first in range(r["first"], r["last"], step):
                    last = min(first + step, r["last"])
                    block = read_rows(r["path"], r["begin"], dtype, r["column_major"], r["shape"], first, last)
                    flat = pa.array(block.astype(dtype.newbyteorder("=")).ravel()).cast(ELEMENTS[element], safe=False)
                    offsets = pa.array(np.arange(0, block.size + 1, max(block.shape[1], 1))[: len(block) + 1].astype(np.int32))
                    if not block.shape[1]:
                        offsets = pa.array(np.zeros(len(block) + 1, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["path"]] * len(block)),
                            pa.array(np.arange(first, last)),
                            pa.array([r["shape"][1:]] * len(block), pa.list_(pa.int64())),
                            pa.ListArray.from_arrays(offsets, flat),
                        ],
                        names=["path", "row", "shape", "values"],
                    )

    dealt = files.select("path").mapInArrow(ranges, _RANGE)
    spread = dealt.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "first")
    return spread.mapInArrow(rows, f"path string, row bigint, shape array<bigint>, values array<{element}>")


# --- manifests


def header_of(path: str, limit: int = HEADER_BYTES) -> list[str] | None:
    """Column names in the first line of a CSV file; None for an empty file."""
    with open_file(path) as f:
        text = f.read(limit).decode("utf-8-sig", errors="replace")
    lines = csv.reader(io.StringIO(text))
    return next(lines, None)


def manifest_headers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path`` and ``header`` of the CSV files found; the first line of each is read in a task."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_of(p) for p in batch.column("path").to_pylist()]
            columns = [batch.column("path"), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "header"])

    files = list_files(spark, path, pattern).select("path")
    dealt = files.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(headers, "path string, header array<string>")


def read_manifests_found(
    spark: SparkSession,
    path: str,
    renames: Mapping[str, str],
    required: Sequence[str],
    optional: Sequence[str],
    pattern: str | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Union of all CSV manifests found at ``path`` (a folder or a pattern), legacy names mapped to the common ones.

    Files of one header are one scan, whatever their number. Values are text, so ids keep their zeros; ``types`` casts
    chosen columns, a value that does not fit being null. Files without a required column are an error that names
    them (ten at most) and their missing columns; empty files are passed over.
    """
    headers = manifest_headers(spark, path, pattern).filter("header IS NOT NULL")
    layouts = headers.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    if not layouts:
        raise DataContractError(f"no manifests at {path}")
    bad = []
    for layout in layouts:
        names = {renames.get(c, c) for c in layout["header"]}
        if missing := [c for c in required if c not in names]:
            bad += [f"{p}: missing {missing}" for p in layout["paths"]]
    if bad:
        raise DataContractError(f"{len(bad)} manifests without required columns: " + "; ".join(bad[:10]))
    parts = []
    for layout in layouts:
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in layout["header"])
        parts.append(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(layout["paths"]))
    out = union_manifests(parts, renames, required, optional)
    return out.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS {t})") for c, t in (types or {}).items()})
