"""Sinks: fixed column order, write-once runs, and results reused by fingerprint."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.ordered import row_index
from ..session import ensure_checkpoint_dir

UNSAFE_IN_RUN_NAME = '/\\<>:"|?*'  # fixed values


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/scratch-{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", mode: str = "errorifexists"):
    """Write the named columns in the given order; arrays are ';'-joined in CSV reports."""
    out = df.select(*columns)
    if fmt == "csv":
        arrays = {f.name: F.array_join(f.name, ";") for f in out.schema if f.dataType.typeName() == "array"}
        out.withColumns(arrays).write.mode(mode).csv(path, header=True)
    else:
        out.write.mode(mode).format(fmt).save(path)


def check_run_name(raw: str) -> str:
    name = raw.strip()
    if not name or name in {".", ".."}:
        raise ValueError("run name must be a plain, non-empty name")
    bad = sorted(set(re.findall(f"[{re.escape(UNSAFE_IN_RUN_NAME)}]", name)))
    if bad:
        raise ValueError(f"run name holds unsafe characters {bad}")
    return name


def write_once(df: DataFrame, root: str, run_name: str, columns: Sequence[str], fmt: str = "parquet") -> str:
    """Write a run under its name; an existing run is never overwritten."""
    path = f"{root}/{check_run_name(run_name)}"
    write_table(df, path, columns, fmt, mode="errorifexists")
    return path


def write_stats(stats: DataFrame, path: str) -> None:
    """One-row statistics as JSON."""
    stats.coalesce(1).write.mode("errorifexists").json(path)


def _digest(*cols: str) -> Column:
    """MD5 of the values as text, nulls told apart from texts."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), {"ignoreNullFields": "false"}))


def dataset_fingerprint(df: DataFrame, key: str, values: Sequence[str] = (), descriptor: str | None = None) -> DataFrame:
    """Row count and two digests of the key set; one pass, independent of row order.

    Each key contributes 60 bits of its MD5 to the xor and the next 20 to the sum, which
    holds for 8 trillion rows. With ``values`` the rows' contents are digested beside the keys, with a
    ``descriptor`` (model, dimension, pooling, order, ...) what was made of them.
    """

    def folded(digest: Column, name: str) -> list[Column]:
        return [
            F.bit_xor(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")).alias(f"{name}_xor"),
            F.sum(F.conv(F.substring(digest, 16, 5), 16, 10).cast("bigint")).alias(f"{name}_sum"),
        ]

    columns = [F.count(F.lit(1)).alias("n"), *folded(F.md5(F.col(key).cast("string")), "key")]
    if values:
        columns += folded(_digest(key, *values), "value")
    out = df.agg(*columns)
    return out if descriptor is None else out.withColumn("descriptor", F.md5(F.lit(descriptor)))


def ordered_fingerprint(df: DataFrame, key: str, order: Sequence[str] = ()) -> str:
    """SHA-256 over the digests of (position, key) in ``order`` (default: the key); any number of rows."""
    rows = row_index(df.select(key, *[c for c in order if c != key]).withColumn("_all", F.lit(0)), ["_all"], list(order) or [key], "_i")
    row = dataset_fingerprint(rows.withColumn("_at", F.concat_ws(":", "_i", F.col(key).cast("string"))), "_at").first()
    return hashlib.sha256("-".join(str(x) for x in row).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def reuse_or_build(
    spark: SparkSession, path: str, fingerprint: DataFrame, build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The stored table when its fingerprint equals the given one, else a fresh build stored beside it.

    The folder name carries the fingerprint, so a table of other inputs is never replaced. The fingerprint
    is written last: without it the rows are not complete. A stored table that cannot be read is an error.
    """
    row = fingerprint.first()
    folder = f"{path}/" + "-".join(str(v) for v in row)
    if _exists(spark, f"{folder}/fingerprint/_SUCCESS"):
        if spark.read.parquet(f"{folder}/fingerprint").first() != row:
            raise ValueError(f"{folder} holds another fingerprint")
        return spark.read.parquet(f"{folder}/rows"), True
    build().write.mode("overwrite").parquet(f"{folder}/rows")
    fingerprint.write.mode("overwrite").parquet(f"{folder}/fingerprint")
    return spark.read.parquet(f"{folder}/rows"), False
