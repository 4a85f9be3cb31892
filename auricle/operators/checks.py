"""Checks that stop a job: counts first, then one error with the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataContractError(ValueError):
    """A table breaks a rule that later steps rely on."""


def require_zero(report: DataFrame, what: str) -> None:
    """Raise when a one-row report holds any count above zero."""
    row = report.first()
    bad = {k: n for k, n in row.asDict().items() if n}
    if bad:
        raise DataContractError(f"{what}: " + ", ".join(f"{k}={n}" for k, n in sorted(bad.items())))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pairing_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys repeated on either side and keys without a partner."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_l") > 1).alias("left_duplicates"),
        F.count_if(F.col("_r") > 1).alias("right_duplicates"),
        F.count_if(F.col("_l").isNull()).alias("missing_left"),
        F.count_if(F.col("_r").isNull()).alias("missing_right"),
    )


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that refuses repeated or unmatched keys on either side."""
    require_zero(pairing_report(left, right, keys), f"one-to-one join on {list(keys)}")
    return left.join(right, list(keys))
