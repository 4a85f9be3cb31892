"""Token counts of flat token files that have no index, by a scan for the end-of-document id.

A file is little-endian uint16 ids, each document followed by the separator. Files are dealt in blocks; a block is
one range read, and one vectorised comparison finds its separators. A document that begins in an earlier block
is stitched by a prefix scan over the blocks' summaries: separators so far, and the place of the last one.
Blocks without a separator are crossed by that scan, so a document may span any number of blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .common import materialize, slices
from .tokens import encoder
from .warc import file_system, read_range

BLOCK_TOKENS = 2_000_000
WIDTH = 2


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Write whole texts (``doc_id``, ``text``) as token files: (``path``, ``tokens``) of each file, and the order of
    its documents (``path``, ``ordinal``, ``doc_id``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        fs, root = file_system(folder)
        encode = encoder(path)
        name, out, ordinal, size = f"{root}/{uuid.uuid4().hex}.bin", None, 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(name + ".tmp")
                ids, bounds = encode(part.column("text"))
                ends = bounds[1:] + np.arange(len(part))
                flat = np.full(len(ids) + len(part), end_id, "<u2")
                spot = np.ones(len(flat), bool)
                spot[ends] = False
                flat[spot] = ids
                out.write(flat.tobytes())
                size += len(flat)
                n = len(part)
                places = pa.array(np.arange(ordinal, ordinal + n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), places, part.column("doc_id"), pa.nulls(n, pa.int64())],
                    names=["path", "ordinal", "doc_id", "tokens"],
                )
                ordinal += n
        if out is not None:
            out.close()
            fs.move(name + ".tmp", name)
            last = [pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([size])]
            yield pa.RecordBatch.from_arrays(last, names=["path", "ordinal", "doc_id", "tokens"])

    # Only files of the tasks that counted are listed.
    rows = materialize(texts.mapInArrow(run, "path string, ordinal long, doc_id long, tokens long"), "token-files")
    files = rows.where(F.col("tokens").isNotNull()).select("path", "tokens")
    return files, rows.where(F.col("ordinal").isNotNull()).select("path", "ordinal", "doc_id")


def scan(files: DataFrame, folder: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the files (``path``, ``tokens``): ``path, ordinal, start, n_tokens, ended``.

    Ids after the last separator are a document that is not ``ended``; a file that ends with a separator, or is
    empty, has none. Two separators in a row are an empty document.
    """
    last = F.floor((F.col("tokens") - 1) / block_tokens)
    blocks = files.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
                begin = block * block_tokens
                with fs.open_input_file(path) as file:
                    raw = read_range(file, WIDTH * begin, WIDTH * min(block_tokens, tokens - begin))
                ends = np.flatnonzero(np.frombuffer(raw, "<u2") == end_id) + begin
                starts = np.concatenate([[-1], ends[:-1] + 1]) if len(ends) else ends
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n, pa.string()),
                        pa.array(np.full(n, block, np.int64)),
                        pa.array(np.arange(n)),
                        pa.array(starts.astype(np.int64), mask=np.arange(n) == 0),
                        pa.array(ends.astype(np.int64)),
                    ],
                    names=["path", "block", "place", "start", "end"],
                )

    found = blocks.repartition("path", "block").mapInArrow(
        run, "path string, block long, place long, start long, end long"
    )
    found = materialize(found, "separators")
    summary = found.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("open"),
    )
    start = F.coalesce("start", "open")
    ended = found.join(carried, ["path", "block"]).select(
        "path",
        (F.col("before") + F.col("place")).alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    whole = summary.groupBy("path").agg(F.sum("n").alias("n"), (F.max("last") + 1).alias("open"))
    tails = files.join(whole, "path", "left").fillna(0, ["n", "open"]).where("open < tokens")
    return ended.unionByName(
        tails.select(
            "path",
            F.col("n").alias("ordinal"),
            F.col("open").alias("start"),
            (F.col("tokens") - F.col("open")).alias("n_tokens"),
            F.lit(False).alias("ended"),
        )
    )


def token_counts(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``, counted in token files written from the whole texts.

    Null and empty texts count 0 ids; null ids stay null; repeated rows are counted each; other columns are
    ignored; an empty table gives no rows. The separator must be an id that no text has.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    files, order = write_tokens(docs, folder, path, end_id)
    counted = scan(files, folder, end_id)
    return order.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
