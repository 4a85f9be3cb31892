"""Evaluation: confusion, per-class and summary metrics, window-to-clip aggregation, error slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.columns import ratio


def confusion_matrix(preds: DataFrame, true: str, pred: str, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of every (true, predicted) pair, zeros included; one matrix per ``keys`` value.

    Predictions that are null or no class of the list are counted under a null ``pred_id``, so that the
    support of each true class stays whole. Rows whose true class is not in the list are not evaluated.

    The rows are counted by their raw prediction, in one pass; all else happens on the counts.
    """
    raw = (
        preds.select(*keys, F.col(true).alias("_true"), F.col(pred).alias("_pred"))
        .filter(F.col("_true").between(0, n_classes - 1))
        .groupBy(*keys, "_true", "_pred")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    listed = F.when(F.col("_pred").between(0, n_classes - 1), F.col("_pred").cast("int"))
    counts = raw.groupBy(*keys, F.col("_true").cast("int").alias("true_id"), listed.alias("pred_id")).agg(F.sum("_n").alias("n"))
    # At most n_classes * (n_classes + 1) cells a key: the grid is filled inside the row.
    cell = F.struct(F.col("true_id") * n_classes + F.col("pred_id"), F.col("n"))
    cells = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("pred_id").isNotNull(), cell))).alias("_listed"),
        F.collect_list(F.when(F.col("pred_id").isNull(), F.struct("true_id", "pred_id", "n"))).alias("_unlisted"),
    )
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes * n_classes - 1)),
        lambda i: F.struct(
            F.floor(i / n_classes).cast("int").alias("true_id"),
            (i % n_classes).cast("int").alias("pred_id"),
            F.coalesce(F.element_at("_listed", i), F.lit(0).cast("bigint")).alias("n"),
        ),
    )
    return cells.select(*keys, F.explode(F.concat(grid, "_unlisted")).alias("_c")).select(*keys, "_c.*")


def confusion_pivot(confusion: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide form: one row per true class, one column per predicted class name."""
    wide = confusion.groupBy("true_id").agg(
        *[F.sum(F.when(F.col("pred_id") == i, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(names)]
    )
    labels = F.array(*[F.lit(n) for n in names])
    return wide.select(F.element_at(labels, F.col("true_id") + 1).alias("actual"), *names)


def per_class_prf(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class; 0 where undefined."""
    diagonal = F.when(F.equal_null("true_id", "pred_id"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    # Each cell counts for its true class and for its predicted one.
    sides = F.array(
        F.struct(F.col("true_id").alias("class_id"), F.col("n").alias("support"), diagonal.alias("tp"), none.alias("predicted")),
        F.struct(F.col("pred_id").alias("class_id"), none.alias("support"), none.alias("tp"), F.col("n").alias("predicted")),
    )
    rows = (
        confusion.select(*keys, F.explode(sides).alias("_s"))
        .select(*keys, "_s.*")
        .filter("class_id IS NOT NULL")
        .groupBy(*keys, "class_id")
        .agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    )
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return (
        rows.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", f1)
        .select(*keys, "class_id", "support", "tp", "precision", "recall", "f1")
    )


def summary_metrics(prf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples, accuracy, and macro and support-weighted averages over the fixed class list."""
    metrics = ("precision", "recall", "f1")
    sums = prf.groupBy(*keys).agg(
        F.sum("support").alias("samples"),
        F.sum("tp").alias("correct"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[F.sum(F.col(m) * F.col("support")).alias(f"_{m}") for m in metrics],
    )
    return sums.select(
        *keys,
        "samples",
        "correct",
        ratio(F.col("correct"), F.col("samples")).alias("accuracy"),
        *[f"macro_{m}" for m in metrics],
        *[ratio(F.col(f"_{m}"), F.col("samples")).alias(f"weighted_{m}") for m in metrics],
    )


def _clip_sums(windows: DataFrame, clip: str, probabilities: str, n_classes: int, votes: bool) -> DataFrame:
    """Windows, mean vector ``mean_p`` and vote counts per clip: one wide aggregate, nothing exploded."""
    aggs = [F.avg(F.get(F.col(probabilities), F.lit(i))).alias(f"_m{i}") for i in range(n_classes)]
    if votes:
        windows = windows.withColumn("_vote", v.argmax(probabilities))
        aggs += [F.count_if(F.col("_vote") == i).alias(f"_v{i}") for i in range(n_classes)]
    sums = windows.groupBy(clip).agg(F.count(F.lit(1)).alias("n_windows"), *aggs)
    out = [F.array(*[F.col(f"_m{i}") for i in range(n_classes)]).alias("mean_p")]
    if votes:
        out.append(F.array(*[F.col(f"_v{i}") for i in range(n_classes)]).alias("votes"))
    return sums.select(clip, "n_windows", *out)


def _vote_of(n_classes: int) -> Column:
    """Most votes; ties go to the higher mean probability, then the lower id."""
    ranked = [
        F.struct(F.col("votes")[i].alias("votes"), F.col("mean_p")[i].alias("mean"), F.lit(-i).alias("neg"))
        for i in range(n_classes)
    ]
    return (-F.array_max(F.array(*ranked))["neg"]).cast("int")


def clip_mean_softmax(windows: DataFrame, clip: str, probabilities: str, n_classes: int) -> DataFrame:
    """Mean probability vector per clip and its argmax."""
    return _clip_sums(windows, clip, probabilities, n_classes, votes=False).withColumn(
        "pred_mean_softmax", v.argmax("mean_p")
    )


#: Rows of a table that are looked at together; 2^33, the row numbers of a partition, is a multiple.
RUN = 1 << 16


def _best(values: Column, k: int) -> Column:
    """The k largest non-null entries of an array, largest first."""
    return F.slice(F.sort_array(F.filter(values, lambda x: x.isNotNull()), asc=False), 1, k)


def clip_topk_mean(windows: DataFrame, clip: str, probabilities: str, n_classes: int, k: int) -> DataFrame:
    """Per class the mean of the k best windows, then the argmax; null scores do not count.

    The windows of a clip that lie together (runs of ``RUN`` rows) are cut to k scores a class before the clip's runs
    meet, so a clip of any length is a list of k scores a class and run at most.
    """
    classes = range(n_classes)

    def scores_of(i: int) -> Column:
        return F.transform("_all", lambda p: F.get(p, F.lit(i)))

    run = F.floor(F.monotonically_increasing_id() / RUN)
    here = windows.select(clip, run.alias("_run"), F.col(probabilities).alias("_p"))
    parts = here.groupBy(clip, "_run").agg(F.collect_list("_p").alias("_all"))
    best = [_best(scores_of(i), k).alias(f"_b{i}") for i in classes]
    whole = parts.select(clip, *best).groupBy(clip).agg(*[F.flatten(F.collect_list(f"_b{i}")).alias(f"_b{i}") for i in classes])
    means = whole.select(clip, *[_best(F.col(f"_b{i}"), k).alias(f"_b{i}") for i in classes]).select(
        clip, F.array(*[F.when(F.size(f"_b{i}") > 0, v.mean(f"_b{i}")) for i in classes]).alias("_means")
    )
    return means.select(clip, v.argmax("_means").alias("pred_topk_mean"))


def clip_majority_vote(windows: DataFrame, clip: str, probabilities: str, n_classes: int) -> DataFrame:
    """Most voted class per clip."""
    sums = _clip_sums(windows, clip, probabilities, n_classes, votes=True)
    return sums.select(clip, _vote_of(n_classes).alias("pred_majority_vote"))


def clip_predictions(
    windows: DataFrame, truth: DataFrame, clip: str, probabilities: str, n_classes: int, k: int = 5
) -> DataFrame:
    """Truth and the three clip-level predictions; clips without windows keep null predictions."""
    sums = _clip_sums(windows, clip, probabilities, n_classes, votes=True).select(
        clip, "n_windows", v.argmax("mean_p").alias("pred_mean_softmax"), _vote_of(n_classes).alias("pred_majority_vote")
    )
    return (
        truth.join(sums, clip, "left")
        .join(clip_topk_mean(windows, clip, probabilities, n_classes, k), clip, "left")
        .withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    )


def level_comparison(windows: DataFrame, clips: DataFrame, true: str, window_pred: str, n_classes: int) -> DataFrame:
    """Summary metrics of the window level and the three clip levels.

    The levels are reduced to one confusion count before any metric is taken.
    """
    scored = clips.filter(F.col("n_windows") > 0)
    levels = F.array(
        *[
            F.struct(F.lit(f"clip_{p}").alias("level"), F.col(f"pred_{p}").alias("_pred"))
            for p in ("mean_softmax", "topk_mean", "majority_vote")
        ]
    )
    rows = scored.select(F.col(true), F.explode(levels).alias("l")).select(true, "l.level", "l._pred").unionByName(
        windows.select(true, F.lit("window").alias("level"), F.col(window_pred).alias("_pred"))
    )
    return summary_metrics(per_class_prf(confusion_matrix(rows, true, "_pred", n_classes, ["level"]), ["level"]), ["level"])


def top_confusions(confusion: DataFrame, names: Sequence[str], limit: int = 15) -> DataFrame:
    """Largest off-diagonal cells with their share of the true class."""
    totals = confusion.groupBy("true_id").agg(F.sum("n").alias("_t"))
    labels = F.array(*[F.lit(n) for n in names])
    return (
        confusion.filter((F.col("true_id") != F.col("pred_id")) & (F.col("n") > 0))
        .join(totals, "true_id")
        .select(
            F.element_at(labels, F.col("true_id") + 1).alias("actual"),
            F.element_at(labels, F.col("pred_id") + 1).alias("predicted"),
            F.col("n").alias("count"),
            (F.col("n") / F.col("_t")).alias("rate"),
        )
        .orderBy(F.desc("count"), "actual", "predicted")
        .limit(limit)
    )


def subgroup_recall(clips: DataFrame, true: str, pred: str, target: int, covariate: str, limit: float) -> DataFrame:
    """Recall of one class below and at or above a covariate limit; unscored clips count in total only."""
    own = clips.filter(F.col(true) == target)
    bucket = (
        F.when(F.col(covariate) < limit, "below").when(F.col(covariate) >= limit, "at_or_above").otherwise("unknown")
    )
    out = own.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(pred).alias("assessed"),
        F.count_if(F.col(pred) == target).alias("correct"),
    )
    return out.withColumn("recall", ratio(F.col("correct"), F.col("assessed")))


def dominant_source(ledger: DataFrame, cls: str, source: str) -> DataFrame:
    """Most frequent source per class; the lower name on ties."""
    counts = ledger.filter(F.col(source).isNotNull()).groupBy(cls, source).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(cls).agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(source).alias("s")))["s"].alias("dominant")
    )


def within_cross_errors(clips: DataFrame, true: str, pred: str, dominant: DataFrame, cls: str) -> DataFrame:
    """Error pairs and whether both classes are dominated by the same source."""
    pairs = (
        clips.filter(F.col(pred).isNotNull() & (F.col(pred) != F.col(true)))
        .groupBy(F.col(true).alias("true_id"), F.col(pred).alias("pred_id"))
        .agg(F.count(F.lit(1)).alias("clips"))
    )
    a = dominant.select(F.col(cls).alias("true_id"), F.col("dominant").alias("_a"))
    b = dominant.select(F.col(cls).alias("pred_id"), F.col("dominant").alias("_b"))
    kind = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unclassifiable")
        .when(F.col("_a") == F.col("_b"), "within")
        .otherwise("cross")
    )
    return (
        pairs.join(a, "true_id", "left")
        .join(b, "pred_id", "left")
        .select("true_id", "pred_id", kind.alias("error_kind"), "clips")
    )


def recall_by_source(clips: DataFrame, true: str, pred: str, source: str) -> DataFrame:
    """Recall per class and source, for classes with more than one source among scored clips."""
    rows = (
        clips.filter(F.col(pred).isNotNull() & F.col(source).isNotNull())
        .groupBy(true, source)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred) == F.col(true)).alias("correct"))
    )
    several = rows.groupBy(true).agg(F.count(F.lit(1)).alias("_s")).filter("_s > 1").select(true)
    return rows.join(several, true, "left_semi").withColumn("recall", F.col("correct") / F.col("n"))


def restrict_common_set(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Only the entities present in a reference run."""
    return df.join(reference.select(key).distinct(), key, "left_semi")


def restriction_counts(clips: DataFrame, reference: DataFrame, key: str, cls: str) -> DataFrame:
    """Kept and total entities per class under a restriction."""
    marks = reference.select(key).distinct().withColumn("_in", F.lit(True))
    return clips.join(marks, key, "left").groupBy(cls).agg(
        F.count("_in").alias("kept"), F.count(F.lit(1)).alias("total")
    )

