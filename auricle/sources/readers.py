"""Typed sources. A schema is always given; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import require_zero
from ..operators.curation import union_manifests

# Suffixes of media files.
MEDIA_SUFFIXES = ("wav", "flac", "mp3", "ogg", "aiff", "aif")


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header row; a header that disagrees with the schema is an error."""
    df = spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)
    return df.select(*columns) if columns else df


def read_csv_headerless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=False)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; "audio.bytes" reads one field of a struct."""
    return spark.read.parquet(path).select(*columns)


def file_inventory(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path, name, size and SHA-256 of files given with their content; a null content has neither."""
    return files.select(
        path,
        F.element_at(F.split(path, "/"), -1).alias("file_name"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"),
    )


def read_files(spark: SparkSession, path: str, suffixes: Sequence[str] = MEDIA_SUFFIXES) -> DataFrame:
    """``path`` and ``content`` of each matching file below ``path``; a file of more than 2 GB is an error."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select("path", "content")


def read_manifests(
    spark: SparkSession,
    sources: Mapping[str, str],
    renames: Mapping[str, str],
    required: Sequence[str],
    optional: Sequence[str],
) -> DataFrame:
    """Union of manifests (path -> schema), legacy names mapped to the common ones."""
    parts = [read_csv(spark, path, schema) for path, schema in sources.items()]
    return union_manifests(parts, renames, required, optional)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_arrays(spark: SparkSession, path: str, column: str, length: int, columns: Sequence[str]) -> DataFrame:
    """Table with one fixed-length array per row; a row of another length is an error."""
    df = spark.read.parquet(path).select(*columns, column)
    require_zero(
        df.agg(F.count_if(F.coalesce(F.size(column), F.lit(-1)) != length).alias("rows_of_wrong_length")), column
    )
    return df
