"""Roles of the test tables in the data model, as DataFrames and as SQL.

orders are clips (customer = source group, priority = class, status = source), lineitem
rows are their windows, documents are files of a manifest, embeddings are vectors and
64-sample signals, events are detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

ORDER_CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANG_CLASSES = ("de", "en", "es", "fr")
EVENT_CLASSES = ("click", "error", "purchase", "signup", "view")


def taxonomy(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "class_id int, class_name string")


def taxonomy_sql(names) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"(SELECT * FROM (VALUES {rows}) AS t(class_id, class_name))"


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """One clip per order; amounts in whole cents, so that sums are exact."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"),
        F.col("o_custkey").alias("group_key"),
        F.col("o_orderpriority").alias("project_class"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("class_id"),
        F.col("o_orderstatus").alias("source_dataset"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("bigint").alias("days"),
    )


CLIPS_SQL = """(SELECT o_orderkey AS clip_id, o_custkey AS group_key, o_orderpriority AS project_class,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS class_id, o_orderstatus AS source_dataset,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest view of the documents: file name, content hash, duration in seconds (n_chars / 500)."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("source_dataset"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.col("lang").alias("project_class"),
        F.sha2("text", 256).alias("sha256"),
        "n_chars",
        (F.col("n_chars") / 500.0).alias("duration"),
    )


DOCUMENTS_SQL = """(SELECT doc_id, source AS source_dataset, 'doc_' || doc_id || '.txt' AS source_file,
  lang AS project_class, sha256(text) AS sha256, n_chars, n_chars / 500.0::DOUBLE AS duration FROM documents)"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 64-sample signals: clip id, class id and samples."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"), F.col("label").alias("class_id"), F.col("embedding").alias("samples")
    )


SIGNALS_SQL = "(SELECT vec_id AS clip_id, label AS class_id, embedding AS samples FROM embeddings)"


def hash_split(key: str):
    """A split drawn from the key's hash alone: 70 / 15 / 15 in expectation."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), F.col(key).cast("string"))), 1, 4), 16, 10)
    share = digit.cast("int")
    return F.when(share < 45875, "train").when(share < 55705, "val").otherwise("test")


def hash_split_sql(key: str) -> str:
    share = f"CAST('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 4) AS INTEGER)"
    return f"CASE WHEN {share} < 45875 THEN 'train' WHEN {share} < 55705 THEN 'val' ELSE 'test' END"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as detections: session, sequence, time in microseconds, label, confidence."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_type").alias("label"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
    )


DETECTIONS_SQL = """(SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) AS ts_us, event_type AS label,
  least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM events)"""
