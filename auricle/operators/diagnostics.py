"""Diagnostics: normalization, confounding by source, label support, class weights, contracts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from .checks import DataContractError
from .models import collect_matrix, mean_vectors
from .ordered import exact_quantiles

CONFOUND_SHARE = 0.80  # fixed values: share above which a class hangs on one source; saturation
SATURATION = 0.95


def class_grid(taxonomy: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Every (split, class): the base of reports that list empty classes too."""
    return taxonomy.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))


def normalization_audit(
    windows: DataFrame, values: str, taxonomy: DataFrame, splits: Sequence[str], low_values: int
) -> DataFrame:
    """Floor and saturation shares, mean, deviation and band means per split and class.

    The array is band-major: its first ``low_values`` entries are the low bands. Sums are
    taken inside each row, so no array is exploded.
    """
    x = F.col(values)
    low = F.slice(x, 1, low_values)
    high = F.slice(x, low_values + 1, F.greatest(F.size(x) - low_values, F.lit(0)))
    per_row = windows.select(
        "split",
        "class_id",
        F.size(x).alias("n"),
        v.total(x).alias("s"),
        F.aggregate(x, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")).alias("q"),
        v.count_where(x, lambda e: e == 0).alias("floor"),
        v.count_where(x, lambda e: e >= SATURATION).alias("top"),
        v.total(low).alias("low_s"),
        v.total(high).alias("high_s"),
        F.size(high).alias("high_n"),
        v.count_where(high, lambda e: e == 0).alias("high_floor"),
    )
    sums = per_row.groupBy("split", "class_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("n").alias("n_values"),
        F.sum("floor").alias("n_at_floor"),
        F.sum("top").alias("n_ge_095"),
        *[F.sum(c).alias(f"_{c}") for c in ("s", "q", "low_s", "high_s", "high_n", "high_floor")],
    )
    spread = F.sqrt(F.greatest(F.try_divide("_q", "n_values") - F.try_divide("_s", "n_values") ** 2, F.lit(0.0)))
    rows = class_grid(taxonomy, splits).join(sums, ["split", "class_id"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_windows", "n_values", "n_at_floor", "n_ge_095")}
    mean = F.try_divide("_s", "n_values")
    low_n = F.col("n_values") - F.col("_high_n")
    return rows.select(
        "split",
        "class_id",
        "class_name",
        *[c.alias(n) for n, c in zero.items()],
        F.try_divide("n_at_floor", "n_values").alias("frac_at_floor"),
        mean.alias("mean_norm"),
        F.when(F.col("n_values") > 0, spread).alias("std_norm"),
        F.try_divide(F.col("_low_s"), low_n).alias("mean_low_bands"),
        F.try_divide("_high_s", "_high_n").alias("mean_high_bands"),
        F.try_divide("_high_floor", "_high_n").alias("frac_at_floor_high_bands"),
        F.try_divide("n_ge_095", "n_values").alias("frac_ge_095"),
    )


def bounds_scope_check(stats: DataFrame, lo: str, hi: str, splits: Sequence[str]) -> DataFrame:
    """GLOBAL when the statistics hold one pair of bounds and no pair per split."""
    has = set(stats.columns)
    single = {lo, hi} <= has
    per_split = any(f"{b}_{s}" in has for b in (lo, hi) for s in splits)
    return stats.select(F.lit("GLOBAL" if single and not per_split else "NOT GLOBAL").alias("scope"))


def _share_of_class(counts: DataFrame, cls: str, columns: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(cls).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    return counts.join(totals, cls)


def class_source_confounding(clips: DataFrame, cls: str, source: str, n_windows: str = "n_windows") -> DataFrame:
    """Clip and window share of each source inside its class; flagged above 80 %."""
    counts = clips.groupBy(cls, source).agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum(F.coalesce(n_windows, F.lit(0))).alias("n_windows")
    )
    out = _share_of_class(counts, cls, ["n_clips", "n_windows"])
    clip_share = F.col("n_clips") / F.col("_t_n_clips")
    window_share = F.try_divide("n_windows", "_t_n_windows")
    flag = (clip_share > CONFOUND_SHARE) | F.coalesce(window_share > CONFOUND_SHARE, F.lit(False))
    return out.select(
        cls, source, "n_clips", "n_windows", clip_share.alias("clip_share"), window_share.alias("window_share"),
        flag.alias("flag_over_80"),
    )


def class_rate_confounding(clips: DataFrame, cls: str, rate: str) -> DataFrame:
    """Share of each sample rate inside its class; a missing rate is -1 and marked."""
    counts = clips.groupBy(cls, rate).agg(F.count(F.lit(1)).alias("n_clips"))
    share = F.col("n_clips") / F.col("_t_n_clips")
    return _share_of_class(counts, cls, ["n_clips"]).select(
        cls,
        F.coalesce(F.col(rate), F.lit(-1)).cast("bigint").alias(rate),
        "n_clips",
        share.alias("clip_share"),
        F.col(rate).isNull().alias("sample_rate_missing"),
        (share > CONFOUND_SHARE).alias("flag_single_rate"),
    )


def zero_window_report(clips: DataFrame, windows: DataFrame, clip: str, keys: Sequence[str]) -> DataFrame:
    """Clips without any window, counted per key."""
    return (
        clips.join(windows.select(clip).distinct(), clip, "left_anti")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_zero_window"))
    )


def below_threshold_share(clips: DataFrame, taxonomy: DataFrame, cls: str, value: str, limit: float) -> DataFrame:
    """Share of clips below a limit per class; classes without clips have a null share."""
    counts = clips.groupBy(cls).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(value) < limit, F.lit(False))).alias("below")
    )
    out = taxonomy.join(counts, F.col("class_name") == F.col(cls), "left")
    total, below = F.coalesce("total", F.lit(0)), F.coalesce("below", F.lit(0))
    return out.select(
        "class_id", "class_name", total.alias("total"), below.alias("below"), F.try_divide(below, total).alias("share")
    )


def class_centroids(windows: DataFrame, values: str, cls: str) -> DataFrame:
    """Mean vector and number of train rows per class."""
    train = windows.filter(F.col("split") == "train")
    return mean_vectors(train, [cls], values, "centroid").withColumnRenamed("n", "n_train")


def centroid_margins(rows: DataFrame, values: str, cls: str, centroids: DataFrame, name: str = "margin") -> DataFrame:
    """Squared distance to the nearest other centroid minus that to the own one, per row.

    Null for a row whose class has no centroid. The centroids are one small matrix, its
    size checked, applied to Arrow batches.
    """
    ids, matrix = collect_matrix(centroids, cls, "centroid")
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((np.asarray(ids), matrix))

    @F.pandas_udf("double")
    def margin(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids, c = shared.value
        order = np.argsort(ids)
        c_sq = (c * c).sum(axis=1)
        for vec, label in batches:
            if not len(vec):
                yield pd.Series([], dtype="float64")
                continue
            x = np.stack(vec.to_numpy()).astype(np.float64)
            dist = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + c_sq
            at = np.searchsorted(ids[order], label.to_numpy())
            col = order[np.clip(at, 0, len(ids) - 1)]
            known = ids[col] == label.to_numpy()
            pick = np.arange(len(x))
            own = dist[pick, col].copy()
            dist[pick, col] = np.inf
            yield pd.Series(np.where(known, dist.min(axis=1) - own, np.nan))

    return rows.withColumn(name, margin(F.col(values), F.col(cls)))


def margin_support(margins: DataFrame, keys: Sequence[str], margin: str = "margin") -> DataFrame:
    """Rows, share of non-positive margins, mean and median margin per key."""
    stats = margins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.try_divide(F.count_if(F.col(margin) <= 0), F.count(margin)).alias("frac_centroid_confusable"),
        F.avg(margin).alias("mean_margin"),
    )
    return stats.join(exact_quantiles(margins, keys, margin, {"median_margin": 0.5}), list(keys), "left")


def worst_k(df: DataFrame, share: str, keys: Sequence[str], k: int = 5) -> DataFrame:
    return df.filter(F.col(share).isNotNull()).orderBy(F.desc(share), *keys).limit(k)


def class_weights(windows: DataFrame, cls: str, taxonomy: DataFrame, strict: bool = True) -> DataFrame:
    """Balanced weights: N / (C n) per class, and N / (2 n) of its one-against-rest targets."""
    counts = windows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    rows = taxonomy.select(F.col("class_id").alias(cls)).join(counts, cls, "left")
    if strict:
        empty = [r[0] for r in rows.filter(F.col("n").isNull()).select(cls).collect()]
        if empty:
            raise DataContractError(f"no training rows for classes {sorted(empty)}")
    total = counts.agg(F.sum("n")).scalar()
    c = taxonomy.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        cls,
        "n",
        (total / (c * F.col("n"))).alias("weight"),
        (total / (2 * F.col("n"))).alias("weight_one"),
        F.try_divide(total.cast("double"), (2 * (total - F.col("n"))).cast("double")).alias("weight_rest"),
    )


def contract_violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """(check, n) rows: how many rows break each named rule; rules that hold are left out."""
    counts = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(n) for n, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in rules])
    return counts.select(F.explode(pairs).alias("c")).select("c.*").filter("n > 0")


def dataset_contract_check(windows: DataFrame, values: str, label: str, length: int, n_classes: int, expected: DataFrame):
    """Feature rows against their statistics: shapes, labels, value range and window counts per split."""
    x = F.col(values)
    rows = contract_violations(
        windows,
        wrong_shape=F.size(x) != length,
        label_out_of_range=~F.col(label).between(0, n_classes - 1),
        value_out_of_range=(F.array_min(x) < 0) | (F.array_max(x) > 1),
    )
    got = windows.groupBy("split").agg(F.count(F.lit(1)).alias("_got"))
    counts = expected.select("split", F.col("windows").alias("_want")).join(got, "split", "full_outer")
    return rows.unionByName(
        contract_violations(counts, window_count_differs=~F.equal_null(F.col("_got"), F.col("_want")))
    )


def window_label_consistency(windows: DataFrame, clips: DataFrame, clip: str, cls: str) -> DataFrame:
    """Clips whose windows carry several labels, or another label than the split table."""
    seen = windows.groupBy(clip).agg(F.min(cls).alias("_lo"), F.max(cls).alias("_hi"))
    truth = clips.select(clip, F.col(cls).alias("_truth"))
    problem = F.when(F.col("_lo") != F.col("_hi"), "several_labels").when(
        F.col("_lo") != F.col("_truth"), "differs_from_splits"
    )
    return (
        seen.join(truth, clip, "left")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select(clip, "problem")
    )
