"""File queries: the given tables are written as files of another form and read back by ranges."""

from __future__ import annotations

import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import service
from ..sources import files, sinks
from .registry import query, table


def shared_folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder, for files that tasks write themselves."""
    folder = sinks.scratch_path(spark, name)
    return "/" + folder[len("file:") :].lstrip("/") if folder.startswith("file:") else folder


def write_files(rows, folder: str):
    """Write (name, content) rows as files from the tasks that hold them; returns the number of files.

    A task that runs twice writes the same files.
    """

    def written(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    return rows.mapInArrow(written, "name string").count()


@query(
    "src_file_hashes",
    """SELECT 'page_' || page_id || '.html' AS file_name, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, sha256(html) AS sha256 FROM pages""",
)
def src_file_hashes(spark, sf):
    """Pages as files, listed and hashed a range at a time."""
    folder = shared_folder(spark, "pages")
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))
    write_files(table(spark, sf, "pages").select(name.alias("name"), F.col("html").cast("binary").alias("content")), folder)
    return files.inventory(spark, folder, ["html"]).select("file_name", "size_bytes", "sha256")


def array_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, values)
    return out.getvalue()


@query(
    "src_array_files",
    """SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(i - 1 AS INTEGER) AS place, embedding[i] AS value
       FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)""",
)
def src_array_files(spark, sf):
    """Vectors as array files of two types and both element orders, with their ids and labels in files beside them."""
    folder = shared_folder(spark, "arrays")

    def packed(batches):
        for at, batch in enumerate(batches):
            ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            x = batch.column("embedding").flatten().to_numpy().reshape(len(batch), -1)
            if not len(batch):
                continue
            stem = f"part-{ids[0]}-{at}"
            wide = np.asfortranarray(x.astype(">f8")) if at % 2 == 0 else x.astype("<f4")
            made = {f"{stem}.x.npy": wide, f"{stem}.id.npy": np.stack([ids, labels], axis=1)}
            columns = [pa.array(list(made)), pa.array([array_bytes(v) for v in made.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "content"])

    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding").repartition(4, "vec_id")
    write_files(rows.mapInArrow(packed, "name string, content binary"), folder)
    stem = F.regexp_extract("path", r"([^/]*)\.(x|id)\.npy$", 1).alias("stem")
    vectors = files.read_array_files(spark, folder, "float", "*.x.npy", range_bytes=16_384).select(stem, "row", "values")
    ids = files.read_array_files(spark, folder, "bigint", "*.id.npy").select(stem, "row", F.col("values").alias("ids"))
    return vectors.join(ids, ["stem", "row"]).select(
        F.col("ids")[0].alias("vec_id"), F.col("ids")[1].alias("label"), F.posexplode("values").alias("place", "value")
    )


# Legacy column names.
LEGACY = {"audio_path": "local_path", "slice_file_name": "source_file", "fsID": "source_id", "class": "original_label"}


@query(
    "src_manifest_glob",
    """SELECT 'customer' AS source_dataset, c_name AS source_file, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS source_id, c_mktsegment AS original_label,
         CAST(NULL AS VARCHAR) AS license, round(c_acctbal, 2) AS duration FROM customer
       UNION ALL SELECT 'supplier', s_name, CAST(s_suppkey AS VARCHAR), 'SUPPLIER', 'CC0', NULL FROM supplier
       UNION ALL SELECT 'part', p_name || ' ' || p_partkey, CAST(p_partkey AS VARCHAR), p_type, NULL, NULL FROM part""",
)
def src_manifest_glob(spark, sf):
    """Manifests of three layouts in many files, found by a pattern."""
    root = sinks.scratch_path(spark, "manifests")
    table(spark, sf, "customer").selectExpr(
        "'customer' source_dataset", "c_name slice_file_name", "lpad(cast(c_custkey as string), 9, '0') fsID", "c_mktsegment class",
        "cast(c_acctbal as decimal(20, 2)) duration",
    ).repartition(8, "fsID").write.csv(f"{root}/a", header=True)
    table(spark, sf, "supplier").selectExpr(
        "'supplier' source_dataset", "s_name source_file", "s_suppkey source_id", "'SUPPLIER' original_label", "'CC0' license"
    ).write.csv(f"{root}/b", header=True)
    table(spark, sf, "part").selectExpr(
        "p_type class", "concat(p_name, ' ', p_partkey) source_file", "p_partkey source_id", "'part' source_dataset"
    ).repartition(5, "source_id").write.csv(f"{root}/c", header=True)
    required = ["source_dataset", "source_file", "source_id", "original_label"]
    return files.read_manifests_found(spark, root, LEGACY, required, ["license", "duration"], "*.csv", {"duration": "double"})


def le(x: str, n: int, engine: str) -> str:
    """Hex digits of a number, little-endian, in the words of an engine."""
    byte = "printf('%02x', ({x} >> {s}) & 255)" if engine == "duckdb" else "lpad(hex(shiftright({x}, {s}) & 255), 2, '0')"
    return " || ".join(byte.format(x=f"CAST(({x}) AS BIGINT)", s=8 * k) for k in range(n))


def wav_hex(engine: str) -> str:
    """A WAV file made of a page: its html is the sound, 16-bit mono; other things by its id (``kind``).

    1: chunks of odd size before and after the format; 2: the sound first; 3: no rate; 4: a size that is one too large,
    which the padding of odd sounds makes right; 5: no sound; 6: a longer format, two channels."""
    sound = "hex(encode(html))" if engine == "duckdb" else "hex(cast(html as binary))"
    rate = "CASE kind WHEN 3 THEN 0 ELSE rate END"
    form = f"'666d7420' || {le('16', 4, engine)} || '0100' || '0100' || {le(rate, 4, engine)} || {le('rate * 2', 4, engine)} || '0200' || '1000'"
    wide = f"'666d7420' || {le('18', 4, engine)} || '0100' || '0200' || {le('rate', 4, engine)} || {le('rate * 4', 4, engine)} || '0400' || '1000' || '0000'"
    odd = f"'4c495354' || {le('5', 4, engine)} || '6162636465' || '00'"
    data = f"'64617461' || {le('CASE kind WHEN 4 THEN n + 1 ELSE n END', 4, engine)} || {sound}"
    parts = f"""CASE kind WHEN 1 THEN {odd} || {form} || {odd} || {data} WHEN 2 THEN {data} || CASE WHEN n % 2 = 1 THEN '00' ELSE '' END || {form}
        WHEN 5 THEN {form} || {odd} WHEN 6 THEN {wide} || {data} ELSE {form} || {data} || CASE WHEN n % 2 = 1 THEN '00' ELSE '' END END"""
    return f"'52494646' || {le('n + 36', 4, engine)} || '57415645' || {parts}"


WAV_BYTES = """44 + n + CASE kind WHEN 1 THEN 28 WHEN 5 THEN 6 - n WHEN 6 THEN 2 ELSE 0 END + CASE WHEN kind NOT IN (1, 5, 6) AND n % 2 = 1 THEN 1 ELSE 0 END"""


@query(
    "wav_header_screen",
    f"""SELECT page_id, CASE WHEN large OR kind IN (2, 3, 5) OR (kind = 4 AND n % 2 = 0) THEN NULL ELSE frames / rate::DOUBLE END AS seconds,
          CASE WHEN large THEN 'file too large (limit 3000 bytes)' WHEN kind = 2 THEN 'invalid WAV file: no format chunk' WHEN kind = 3 THEN 'invalid WAV file: broken format chunk'
               WHEN kind = 4 AND n % 2 = 0 THEN 'invalid WAV file: truncated chunk'
               WHEN kind = 5 THEN 'invalid WAV file: no data chunk' WHEN frames / rate::DOUBLE > 0.2 THEN 'file too long (limit 0.2s)' END AS reason
        FROM (SELECT *, {WAV_BYTES} > 3000 AS large, CASE kind WHEN 6 THEN n // 4 WHEN 4 THEN (n + 1) // 2 ELSE n // 2 END AS frames FROM (
          SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, page_id % 8 AS kind, 4000 + page_id % 5 * 1000 AS rate FROM pages))""",
)
def wav_header_screen(spark, sf):
    """Uploads in base64, whose duration is that of their own header."""
    rows = table(spark, sf, "pages").selectExpr(
        "page_id", "html", "cast(octet_length(html) as bigint) n", "page_id % 8 kind", "4000 + page_id % 5 * 1000 rate"
    )
    data = F.replace(F.base64(F.unhex(F.expr(wav_hex("spark")))), F.lit("\r\n"), F.lit(""))
    screened = service.screen_wav(rows.withColumn("data", data), "data", 3000, 0.2)
    return screened.select("page_id", "seconds", "reason")
