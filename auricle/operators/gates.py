"""Gates over split tables and feature rows: each returns the rows that break a rule, or levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import vectors as v
from ..functions.columns import seeded_key
from ..params import (
    CEILING_FRACTION,
    FLOOR_FRACTION,
    KS_MIN_N,
    MEAN_DELTA,
    PAD_FRACTION,
    PROPORTION_TOLERANCE,
    RATIOS,
    SILENCE_SPREAD,
)
from ..session import cut_lineage
from .models import mean_vectors
from .ordered import exact_quantiles, top_n
from .splits import ks_statistic, unpivot


def level_of(value: Column, limits: tuple[float, float]) -> Column:
    flag, severe = limits
    return F.when(value > severe, "severe").when(value > flag, "flag").otherwise("ok")


def membership(kept: DataFrame, splits: DataFrame, key: str, examples: int = 3) -> DataFrame:
    """G1: ids in more than one split row, kept ids without a split, split ids not kept."""
    per_id = splits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ids = kept.select(key).distinct().withColumn("_kept", F.lit(True))
    found = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, F.struct(F.lit("duplicate").alias("problem"), (F.col("_n") - 1).alias("_w"))),
            F.when(F.col("_n").isNull(), F.struct(F.lit("missing").alias("problem"), F.lit(1).cast("bigint").alias("_w"))),
            F.when(F.col("_kept").isNull(), F.struct(F.lit("extra").alias("problem"), F.lit(1).cast("bigint").alias("_w"))),
        )
    )
    # Read twice below: counted, and searched for examples.
    problems = cut_lineage(
        per_id.join(ids, key, "full_outer").select(key, F.explode(found).alias("_p")).select(key, "_p.*")
    )
    counts = problems.groupBy("problem").agg(F.sum("_w").alias("n"))
    shown = top_n(problems, ["problem"], [F.col(key)], examples, [key])
    shown = shown.groupBy("problem").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return counts.join(shown, "problem")


def group_atomicity(clip_splits: DataFrame, group_splits: DataFrame, group: str) -> DataFrame:
    """G2: every group with a problem: several splits, another split in the group table, or missing."""
    per_group = clip_splits.groupBy(group).agg(
        F.array_sort(F.collect_set("split")).alias("splits")
    )
    both = per_group.join(group_splits.select(group, F.col("split").alias("_g")), group, "full_outer")
    problem = (
        F.when(F.col("splits").isNull(), "unknown_to_clips")
        .when(F.col("_g").isNull(), "missing_from_groups")
        .when(F.size("splits") > 1, "several_splits")
        .when(F.col("splits")[0] != F.col("_g"), "tables_disagree")
    )
    return (
        both.withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select(group, "problem", F.coalesce(F.array_join("splits", ","), F.lit("")).alias("clip_splits"), F.col("_g").alias("group_split"))
    )


def hash_disjoint(rows: DataFrame, sha: str) -> DataFrame:
    """G3: content hashes found in more than one split."""
    return (
        rows.groupBy(sha)
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .filter(F.size("splits") > 1)
    )


def proportions(clips: DataFrame, cls: str, ratios: Mapping[str, float] = RATIOS, tolerance=PROPORTION_TOLERANCE):
    """G4 / C1: share of each split per class and overall, its deviation and verdict."""
    wide = (
        clips.groupingSets([[cls], []], cls)
        .agg(F.count(F.lit(1)).alias("n_clips"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ratios])
        .withColumn(cls, F.coalesce(cls, F.lit("ALL")))
    )
    cells = F.array(
        *[F.struct(F.lit(s).alias("split"), (F.col(f"_{s}") / F.col("n_clips")).alias("share"), F.lit(t).alias("target")) for s, t in ratios.items()]
    )
    long = wide.select(cls, "n_clips", F.explode(cells).alias("c")).select(cls, "n_clips", "c.*")
    dev = F.abs(F.col("share") - F.col("target"))
    return long.withColumns({"deviation": dev, "ok": dev <= tolerance})


def artifacts(rows: DataFrame, values: str, label: str, length: int, n_classes: int, expected: DataFrame) -> DataFrame:
    """G5: per split, windows and every kind of bad window; ``expected`` holds split and windows."""
    x = F.col(values)
    bad_value = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    per_split = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.coalesce(F.size(x), F.lit(-1)) != length).alias("wrong_shape"),
        F.count_if(bad_value).alias("non_finite"),
        F.count_if(F.array_min(x) < 0).alias("below_zero"),
        F.count_if(F.array_max(x) > 1).alias("above_one"),
        F.count_if(~F.coalesce(F.col(label).between(0, n_classes - 1), F.lit(False))).alias("bad_label"),
    )
    stats = expected.select("split", F.col("windows").alias("expected_windows"))
    out = per_split.join(stats, "split", "full_outer")
    clean = F.col("windows") == F.col("expected_windows")
    for c in ("wrong_shape", "non_finite", "below_zero", "above_one", "bad_label"):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("ok", F.coalesce(clean, F.lit(False)))


def distribution_stats(clips: DataFrame, cls: str, covariates: Sequence[str]) -> DataFrame:
    """C2: clips, mean, median and sample deviation of each covariate per class and split."""
    long = unpivot(clips, [cls, "split"], covariates).filter(F.col("value").isNotNull())
    keys = [cls, "split", "metric"]
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clips"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return moments.join(exact_quantiles(long, keys, "value", {"median": 0.5}), keys)


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value (Kolmogorov series), not the exact small-sample one."""
    lam = F.sqrt(n * m / (n + m)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.05, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


#: Samples up to this size get the exact p-value.
EXACT_KS = 10_000


def exact_ks_p(d: float, n: int, m: int) -> float:
    """Exact two-sided p-value of D: the share of lattice paths from (0, 0) to (n, m) that leave the band.

    All orders of both samples are equally likely; an order is a path, and D is its largest |i / n - j / m|. The
    share ``q(i, j)`` of the paths to a point that have been outside is 1 outside the band, else
    ``i / (i + j) q(i - 1, j) + j / (i + j) q(i, j - 1)``: sums of positive shares, so small p-values keep
    their digits. One diagonal ``i + j`` is one vector.
    """
    if n > m:
        n, m = m, n
    far = round(d * n * m)
    if far <= 0:
        return 1.0
    i = np.arange(n + 1)
    q = np.zeros(n + 1)
    for k in range(1, n + m + 1):
        lo, hi = max(0, k - m), min(n, k)
        here = i[lo : hi + 1]
        before = q[max(lo - 1, 0) : hi] if lo else np.append(0.0, q[:hi])
        new = (here * before + (k - here) * q[lo : hi + 1]) / k
        new[np.abs(here * m - (k - here) * n) >= far] = 1.0
        q[lo : hi + 1] = new
    return float(q[n])


@F.pandas_udf(DoubleType())
def _exact_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else exact_ks_p(x, int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")


def distribution_ks(clips: DataFrame, cls: str, thresholds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """C2: D of train against val and test per class and metric, with its level.

    The p-value is exact while both samples have at most ``EXACT_KS`` values, the asymptotic series beyond.
    """
    long = unpivot(clips, [cls, "split"], list(thresholds))
    ks = ks_statistic(long, [cls, "metric"], "value")
    fewest = F.least("n_ref", "n_other")
    graded = F.coalesce(*[F.when(F.col("metric") == m, level_of(F.col("d"), t)) for m, t in thresholds.items()])
    enough = fewest >= 2
    small = F.greatest("n_ref", "n_other") <= EXACT_KS
    level = F.when(~enough, "insufficient_n").when(fewest < KS_MIN_N, "underpowered_n").otherwise(graded)
    return ks.select(
        cls,
        "metric",
        F.concat(F.lit("train vs "), "other").alias("comparison"),
        F.when(enough, F.col("d")).alias("ks_d"),
        F.when(enough & small, _exact_p(F.when(enough & small, F.col("d")), "n_ref", "n_other"))
        .when(enough, ks_p_value(F.col("d"), F.col("n_ref"), F.col("n_other")))
        .alias("p_value"),
        level.alias("level"),
    )


def pooled_delta(windows: DataFrame, value: str, limits: tuple[float, float] = MEAN_DELTA) -> DataFrame:
    """C2: window mean and deviation per split, and the distance to the train mean."""
    out = windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.avg(value).alias("feature_mean"), F.stddev_pop(value).alias("feature_std")
    )
    train = windows.filter(F.col("split") == "train").agg(F.avg(value).alias("m")).scalar()
    out = out.withColumn("delta_vs_train", F.when(F.col("split") == "train", 0.0).otherwise(F.col("feature_mean") - train))
    return out.withColumn("level", level_of(F.abs("delta_vs_train"), limits))


def leakage_restate(gates: DataFrame) -> DataFrame:
    """C3: one row per gate of a stored result (gate, problems) that was not clean."""
    return gates.filter(F.coalesce("problems", F.lit(1)) != 0).select("gate", "problems")


def class_mean_arrays(windows: DataFrame, values: str, cls: str) -> DataFrame:
    """C4: element-wise mean array per class and split, as (class, split, position, mean) rows."""
    means = mean_vectors(windows, [cls, "split"], values, "_mean")
    return means.select(cls, "split", F.posexplode("_mean").alias("pos", "mean"))


def class_examples(windows: DataFrame, cls: str, clip: str, start: str, seed: int, n: int = 3) -> DataFrame:
    """C4: seeded example windows, one from each of ``n`` clips per class and split."""
    keyed = windows.select(cls, "split", clip, start).withColumn("_k", seeded_key(seed, clip, start))
    one = keyed.groupBy(cls, "split", clip).agg(F.min(F.struct("_k", start)).alias("_w"))
    one = one.select(cls, "split", clip, F.col(f"_w.{start}").alias(start), seeded_key(seed, clip).alias("_c"))
    return top_n(one, [cls, "split"], [F.col("_c"), F.col(clip)], n, [clip]).drop("_c")


def artifact_levels(window_summary: DataFrame, features: DataFrame, values: str, ledger: DataFrame) -> DataFrame:
    """C5: silence drop, floor and ceiling values, padding and truncation, each with a level.

    ``window_summary``: split, raw_windows, dropped_silent; ``ledger``: kept clips with split,
    pad_fraction and truncated.
    """
    drop = window_summary.select("split", (F.col("dropped_silent") / F.col("raw_windows")).alias("value"))
    rate = drop.select(F.lit("silence_drop_rate").alias("metric"), "split", "value", F.lit("ok").alias("level"))
    spread = drop.agg((F.max("value") - F.min("value")).alias("value")).select(
        F.lit("silence_drop_spread").alias("metric"),
        F.lit("all").alias("split"),
        "value",
        level_of(F.col("value"), SILENCE_SPREAD).alias("level"),
    )
    x = F.col(values)
    seen = features.groupBy("split").agg(
        F.sum(F.size(x)).alias("n"),
        F.sum(v.count_where(x, lambda e: e <= 0.0)).alias("floor"),
        F.sum(v.count_where(x, lambda e: e >= 0.999999)).alias("ceil"),
        F.sum(v.count_where(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))).alias("bad"),
    )
    floor, ceil = F.col("floor") / F.col("n"), F.col("ceil") / F.col("n")
    cells = F.array_compact(
        F.array(
            F.struct(F.lit("floor_value_fraction").alias("metric"), floor.alias("value"), level_of(floor, FLOOR_FRACTION).alias("level")),
            F.struct(F.lit("ceiling_value_fraction").alias("metric"), ceil.alias("value"), level_of(ceil, CEILING_FRACTION).alias("level")),
            F.when(
                F.col("bad") > 0,
                F.struct(F.lit("all_finite").alias("metric"), F.lit(0.0).alias("value"), F.lit("severe").alias("level")),
            ),
        )
    )
    values_rows = seen.select("split", F.explode(cells).alias("c")).select("c.metric", "split", "c.value", "c.level")
    pad = ledger.agg(F.max("pad_fraction").alias("value")).select(
        F.lit("pad_fraction_max").alias("metric"),
        F.lit("all").alias("split"),
        "value",
        level_of(F.col("value"), PAD_FRACTION).alias("level"),
    )
    trunc = ledger.groupBy("split").agg((F.count_if("truncated") / F.count(F.lit(1))).alias("value"))
    trunc_rate = trunc.select(F.lit("truncation_rate").alias("metric"), "split", "value", F.lit("ok").alias("level"))
    trunc_spread = trunc.agg((F.max("value") - F.min("value")).alias("value")).select(
        F.lit("truncation_spread").alias("metric"), F.lit("all").alias("split"), "value", F.lit("ok").alias("level")
    )
    out = rate
    for part in (spread, values_rows, pad, trunc_rate, trunc_spread):
        out = out.unionByName(part)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """FAIL / PASS WITH WARNINGS / PASS from rows with a ``level``.

    "severe" and "fail" rows fail the gate, "flag" rows warn; "underpowered_n" is counted only.
    """
    counts = checks.agg(
        F.count_if(F.col("level").isin("severe", "fail")).alias("severe"),
        F.count_if(F.col("level") == "flag").alias("flags"),
        F.count_if(F.col("level") == "underpowered_n").alias("underpowered"),
        F.count(F.lit(1)).alias("checks"),
    )
    text = F.when(F.col("severe") > 0, "FAIL").when(F.col("flags") > 0, "PASS WITH WARNINGS").otherwise("PASS")
    return counts.withColumn("verdict", text)
