"""Leakage-safe splits: a source group goes to one split as a whole.

Groups are placed by their position in a seeded order inside their class, so the whole
assignment is one pass of aggregates and prefix sums over groups, not a sequential solver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seeded_key
from ..params import KS_MIN_N, PROPORTION_TOLERANCE, RATIOS
from ..session import cut_lineage
from .checks import DataContractError
from .ordered import cumulative_counts, hash_ordered_sum, row_index

# Weights of the imbalance terms, and the activity bound of a deviation.
WEIGHTS = {"count": 1.0, "mean": 1.0, "spread": 0.5, "histogram": 1.0}
KS_OVER_WEIGHT = 3.0
MIN_STD = 1e-6
BINS = 10


def group_class_stats(clips: DataFrame, group: str, cls: str, covariates: Sequence[str]) -> DataFrame:
    """Per group and class: clips, and sum and sum of squares of each covariate."""
    aggs = [F.count(F.lit(1)).alias("k")]
    for c in covariates:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"sum_{c}"), F.sum(x * x).alias(f"sumsq_{c}")]
    return clips.groupBy(group, cls).agg(*aggs)


def dominant_class(clips: DataFrame, group: str, cls: str, covariate: str | None = None) -> DataFrame:
    """Size and most frequent class (lowest name on ties) of each group, and its covariate mean."""
    aggs = [F.count(F.lit(1)).alias("k")]
    total = []
    if covariate:
        aggs.append(F.sum(covariate).alias("s"))
        total.append((F.sum("s") / F.sum("k")).alias("group_mean"))
    return (
        clips.groupBy(group, cls)
        .agg(*aggs)
        .groupBy(group)
        .agg(
            F.sum("k").alias("n_clips"),
            F.min(F.struct((-F.col("k")).alias("neg"), F.col(cls).alias("cls")))["cls"].alias("stratum"),
            *total,
        )
    )


def split_of_share(share: Column, ratios: Mapping[str, float]) -> Column:
    """The split whose share of the unit interval holds ``share``."""
    names = list(ratios)
    out, upper = None, 0.0
    for name in names[:-1]:
        upper = round(upper + ratios[name], 10)
        out = (F if out is None else out).when(share < upper, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def assign_groups(groups: DataFrame, group: str, strata: Sequence[str], ratios=RATIOS) -> DataFrame:
    """Split of each group from the midpoint of its clips in the seeded order of its stratum.

    ``groups`` carries n_clips and the order key ``_key``.
    """
    placed = hash_ordered_sum(groups, strata, "_key", [group], "n_clips", "_cum")
    middle = (F.col("_cum") + F.col("n_clips") / 2.0) / F.col("_cum_total")
    return placed.withColumn("split", split_of_share(middle, ratios)).drop("_cum", "_cum_total", "_key")


def group_stratified_split(clips: DataFrame, group: str, cls: str, seed: int, ratios=RATIOS) -> DataFrame:
    """Group -> split, stratified by the group's dominant class."""
    groups = dominant_class(clips, group, cls).withColumn("_key", seeded_key(seed, group))
    return assign_groups(groups, group, ["stratum"], ratios)


def quantile_rank_bin(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], name: str, bins: int = BINS):
    """Equal-count bin (rank * b) // n of each row inside its key, with b = min(bins, n)."""
    ranked = row_index(df, keys, [value, *tie], "_rank")
    b = F.least(F.lit(bins), F.col("_rank_total"))
    return ranked.withColumn(name, F.floor(F.col("_rank") * b / F.col("_rank_total"))).drop("_rank", "_rank_total")


def covariate_balanced_split(
    clips: DataFrame, group: str, cls: str, covariate: str, seed: int, ratios=RATIOS, bins: int = BINS
) -> DataFrame:
    """As ``group_stratified_split``, with strata (dominant class, quantile bin of the group mean)."""
    groups = dominant_class(clips, group, cls, covariate)
    binned = quantile_rank_bin(groups, ["stratum"], "group_mean", [group], "bin", bins)
    keyed = binned.withColumn("_key", seeded_key(seed, group))
    return assign_groups(keyed, group, ["stratum", "bin"], ratios)


def apply_split(clips: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    return clips.join(groups.select(group, "split"), group)


def group_split_table(clips: DataFrame, group: str, cls: str) -> DataFrame:
    """Group, split, number of clips, sorted classes; ``clips`` carries split."""
    return (
        clips.groupBy(group, "split", cls)
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy(group, "split")
        .agg(F.sum("k").alias("n_clips"), F.array_sort(F.collect_set(cls)).alias("classes"))
    )


def class_split_shares(clips: DataFrame, cls: str, ratios=RATIOS) -> DataFrame:
    """Clips and share of each (class, split), zero cells included, with the deviation from its target."""
    wide = clips.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ratios],
    )
    cells = F.array(
        *[F.struct(F.lit(s).alias("split"), F.col(f"_{s}").alias("k"), F.lit(t).alias("target")) for s, t in ratios.items()]
    )
    long = wide.select(cls, "n", F.explode(cells).alias("c")).select(cls, "n", "c.*")
    return long.withColumn("share", F.col("k") / F.col("n")).withColumn(
        "deviation", F.abs(F.col("share") - F.col("target"))
    )


def max_proportion_deviation(
    clips: DataFrame, cls: str, ratios=RATIOS, limit: float | None = None
) -> DataFrame:
    """Largest absolute deviation of any (class, split); above ``limit`` it is an error."""
    out = class_split_shares(clips, cls, ratios).agg(F.max("deviation").alias("max_deviation"))
    if limit is not None:
        worst = out.first()[0]
        if worst is not None and worst > limit:
            raise DataContractError(f"proportion deviation {worst:.4f} above {limit}")
    return out


def class_covariate_stats(clips: DataFrame, cls: str, covariates: Sequence[str]) -> DataFrame:
    """Mean, population deviation and activity of each covariate per class, long form."""
    long = unpivot(clips, [cls], covariates)
    return (
        long.groupBy(cls, "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .withColumn("active", F.col("std") > MIN_STD)
    )


def unpivot(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids, metric, value) rows, values as doubles."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(*ids, F.explode(pairs).alias("_m")).select(*ids, "_m.metric", "_m.value")


def bin_histogram_match(binned: DataFrame, keys: Sequence[str], bin_col: str = "bin") -> DataFrame:
    """Squared gap between each split's bin histogram and that of its class, per (keys, split).

    ``keys`` name the class, and the metric when there are several.
    """
    # A few rows per class, read four times below.
    counts = cut_lineage(binned.groupBy(*keys, "split", bin_col).agg(F.count(F.lit(1)).alias("k")))
    split_n = counts.groupBy(*keys, "split").agg(F.sum("k").alias("split_n"))
    class_bin = counts.groupBy(*keys, bin_col).agg(F.sum("k").alias("class_k"))
    class_n = counts.groupBy(*keys).agg(F.sum("k").alias("class_n"))
    cells = split_n.join(class_bin, list(keys)).join(class_n, list(keys))
    gap = F.coalesce(F.col("k"), F.lit(0)) / F.col("split_n") - F.col("class_k") / F.col("class_n")
    return (
        cells.join(counts, [*keys, "split", bin_col], "left")
        .groupBy(*keys, "split")
        .agg(F.sum(gap * gap).alias("gap"))
    )


def imbalance_objective(clips: DataFrame, cls: str, covariates: Sequence[str], clip: str, ratios=RATIOS) -> DataFrame:
    """Count, mean, spread and histogram terms of each (class, split), and their weighted sum.

    A constant covariate adds nothing to the mean and spread terms; an empty cell has the
    count term only, a single clip no spread term.
    """
    long = unpivot(clips, [clip, cls, "split"], covariates)
    ref = (
        long.groupBy(cls, "metric")
        .agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    )
    cell = long.groupBy(cls, "metric", "split").agg(
        F.count(F.lit(1)).alias("k"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")
    )
    active = F.col("sd") > MIN_STD
    d = (F.col("m") - F.col("mu")) / F.col("sd")
    r = F.col("s") / F.col("sd") - 1.0
    binned = quantile_rank_bin(long, [cls, "metric"], "value", [clip], "bin")
    hist = bin_histogram_match(binned, [cls, "metric"])
    terms = (
        cell.join(ref, [cls, "metric"])
        .join(hist, [cls, "metric", "split"])
        .groupBy(cls, "split")
        .agg(
            F.sum(F.when(active, d * d).otherwise(0.0)).alias("mean_term"),
            F.sum(F.when(active & (F.col("k") >= 2), r * r).otherwise(0.0)).alias("spread_term"),
            F.sum("gap").alias("histogram_term"),
        )
    )
    shares = class_split_shares(clips, cls, ratios)
    target = F.col("n") * F.col("target")
    off = (F.col("k") - target) / F.greatest(target, F.lit(1.0))
    out = shares.withColumn("count_term", off * off).join(terms, [cls, "split"], "left").na.fill(0.0)
    return out.select(
        cls,
        "split",
        "count_term",
        "mean_term",
        "spread_term",
        "histogram_term",
        (
            WEIGHTS["count"] * F.col("count_term")
            + WEIGHTS["mean"] * F.col("mean_term")
            + WEIGHTS["spread"] * F.col("spread_term")
            + WEIGHTS["histogram"] * F.col("histogram_term")
        ).alias("objective"),
    )


def ks_statistic(df: DataFrame, keys: Sequence[str], value: str, split: str = "split", ref: str = "train", others=("val", "test")):
    """Exact two-sample D of ``ref`` against each other split, per key.

    Equal values are counted first; only distinct (key, value) rows are ordered. D is null
    where either side is empty.
    """
    sides = (ref, *others)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.count_if(F.col(split) == s).alias(s) for s in sides])
    )
    cum = cumulative_counts(counts, keys, value, sides).withColumnsRenamed({f"cum_{s}_total": f"n_{s}" for s in sides})

    def ecdf(s: str) -> Column:
        return F.try_divide(F.col(f"cum_{s}").cast("double"), F.col(f"n_{s}").cast("double"))

    wide = cum.groupBy(*keys).agg(
        *[F.max(f"n_{s}").alias(f"n_{s}") for s in sides],
        *[F.max(F.abs(ecdf(ref) - ecdf(o))).alias(f"d_{o}") for o in others],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(o).alias("other"),
                F.col(f"n_{ref}").alias("n_ref"),
                F.col(f"n_{o}").alias("n_other"),
                F.col(f"d_{o}").alias("d"),
            )
            for o in others
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def ks_crossings_energy(ks: DataFrame, thresholds: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Cells above their flag threshold and the weighted energy; cells below 15 rows a side are left out.

    ``ks`` has a metric column and the columns of ``ks_statistic``.
    """
    limit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(t)) for m, t in thresholds.items()])
    over = F.col("d") > limit
    powered = ks.filter(F.least("n_ref", "n_other") >= KS_MIN_N)
    ratio = F.col("d") / limit
    return powered.groupBy(*keys).agg(
        F.count_if(over).alias("crossings"),
        F.sum(F.when(over, KS_OVER_WEIGHT).otherwise(1.0) * ratio * ratio).alias("energy"),
    )


def seeded_splits(clips: DataFrame, group: str, cls: str, seeds: Sequence[int], ratios=RATIOS) -> DataFrame:
    """One candidate split per seed, all in one job: (seed, group) -> split."""
    groups = dominant_class(clips, group, cls)
    spread = groups.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "_key", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(group).cast("string")))
    )
    return assign_groups(spread, group, ["seed", "stratum"], ratios)


def _ks_of_columns(
    members: DataFrame, cls: str, metrics: Sequence[str], seeds: Sequence[int], ref: str, others: Sequence[str]
) -> DataFrame:
    """``ks_statistic`` per (seed, class, metric), where the splits of seed i are in the column ``_s{i}``.

    Distinct values are ordered once; the running counts of all seeds stand beside each other.
    """
    sides = (ref, *others)
    n = range(len(seeds))
    long = unpivot(members, [cls, *[f"_s{i}" for i in n]], metrics)
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy(cls, "metric", "value")
        .agg(*[F.count_if(F.col(f"_s{i}") == side).alias(f"k{i}_{side}") for i in n for side in sides])
    )
    cum = cumulative_counts(counts, [cls, "metric"], "value", [f"k{i}_{side}" for i in n for side in sides])

    def ecdf(i: int, side: str) -> Column:
        return F.try_divide(
            F.col(f"cum_k{i}_{side}").cast("double"), F.col(f"cum_k{i}_{side}_total").cast("double")
        )

    wide = cum.groupBy(cls, "metric").agg(
        *[F.max(f"cum_k{i}_{side}_total").alias(f"n{i}_{side}") for i in n for side in sides],
        *[F.max(F.abs(ecdf(i, ref) - ecdf(i, o))).alias(f"d{i}_{o}") for i in n for o in others],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("seed"),
                F.lit(o).alias("other"),
                F.col(f"n{i}_{ref}").alias("n_ref"),
                F.col(f"n{i}_{o}").alias("n_other"),
                F.col(f"d{i}_{o}").alias("d"),
            )
            for i, s in enumerate(seeds)
            for o in others
        ]
    )
    return wide.select(cls, "metric", F.explode(rows).alias("_r")).select(cls, "metric", "_r.*")


def best_seed_split(
    clips: DataFrame,
    group: str,
    cls: str,
    thresholds: Mapping[str, float],
    seeds: Sequence[int],
    ratios=RATIOS,
    tolerance: float = PROPORTION_TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """(scores per seed, group -> split of the best seed).

    Best: fewest proportion breaches, then fewest KS crossings, then lowest energy, then lowest seed.
    """
    # The splits of all seeds are columns of one row per clip: rows are counted and ordered once, not once a seed.
    placed = cut_lineage(seeded_splits(clips, group, cls, seeds, ratios))
    sides = list(ratios)
    wide = placed.groupBy(group).agg(*[F.max(F.when(F.col("seed") == s, F.col("split"))).alias(f"_s{i}") for i, s in enumerate(seeds)])
    members = clips.join(wide, group).select(cls, *thresholds, *[f"_s{i}" for i in range(len(seeds))])
    ks = _ks_of_columns(members, cls, list(thresholds), seeds, sides[0], sides[1:])
    energy = ks_crossings_energy(ks, thresholds, ["seed"])
    shares = members.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"_s{i}") == side).alias(f"_{i}_{side}") for i in range(len(seeds)) for side in sides],
    )

    def worst(i: int) -> Column:
        return F.greatest(*[F.abs(F.col(f"_{i}_{side}") / F.col("n") - F.lit(t)) for side, t in ratios.items()])

    off = F.array(*[F.struct(F.lit(s).alias("seed"), (worst(i) > tolerance).alias("off")) for i, s in enumerate(seeds)])
    breaches = shares.select(F.explode(off).alias("b")).groupBy("b.seed").agg(F.count_if("b.off").alias("breaches"))
    scores = breaches.join(energy, "seed", "left").na.fill({"crossings": 0, "energy": 0.0})
    best = scores.agg(F.min(F.struct("breaches", "crossings", F.round("energy", 9), "seed"))["seed"].alias("s")).scalar()
    return scores, placed.filter(F.col("seed") == best)
