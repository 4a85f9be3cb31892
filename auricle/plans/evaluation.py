"""Evaluation queries: lineitem rows as scored windows of orders, order priority as truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import evaluation as op
from .fixtures import CLIPS_SQL, ORDER_CLASSES, clips
from .registry import query, table

K = len(ORDER_CLASSES)
TOP_K = 3


def scored_windows(spark, sf):
    """Five scores per window, each in (0, 1], normalised to sum 1."""
    raw = [
        F.col("l_quantity") / 50.0 + 0.01,
        F.col("l_extendedprice") / 100000.0 + 0.01,
        F.col("l_discount") * 10.0 + 0.01,
        F.col("l_tax") * 12.5 + 0.01,
        (F.col("l_partkey") % 100) / 100.0 + 0.01,
    ]
    rows = table(spark, sf, "lineitem").withColumns({f"_s{i}": r for i, r in enumerate(raw)})
    s = [F.col(f"_s{i}") for i in range(K)]
    rows = rows.withColumn("_total", s[0] + s[1] + s[2] + s[3] + s[4])
    return rows.select(
        F.col("l_orderkey").alias("clip_id"),
        F.xxhash64("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("window_id"),
        F.array(*[x / F.col("_total") for x in s]).alias("p"),
    )


SCORES_SQL = """(SELECT clip_id, list_transform(r, lambda x: x / (r[1] + r[2] + r[3] + r[4] + r[5])) AS p FROM (
  SELECT l_orderkey AS clip_id, [l_quantity / 50.0::DOUBLE + 0.01::DOUBLE, l_extendedprice / 100000.0::DOUBLE + 0.01::DOUBLE,
    l_discount * 10.0::DOUBLE + 0.01::DOUBLE, l_tax * 12.5::DOUBLE + 0.01::DOUBLE, (l_partkey % 100) / 100.0::DOUBLE + 0.01::DOUBLE] AS r FROM lineitem))"""


def truth(spark, sf):
    return clips(spark, sf).select("clip_id", "class_id", "source_dataset", "cents")


def window_predictions(spark, sf):
    rows = scored_windows(spark, sf).select("clip_id", v.argmax("p").alias("pred_id"))
    return rows.join(truth(spark, sf), "clip_id")


WINDOW_PRED_SQL = f"""(SELECT clip_id, class_id, source_dataset, cents, list_position(p, list_max(p)) - 1 AS pred_id
  FROM {SCORES_SQL} JOIN {CLIPS_SQL} USING (clip_id))"""
MEAN_SQL = f"""(SELECT clip_id, max(n) AS n_windows, arg_min(c, (-m, c)) AS pred_mean_softmax FROM (
  SELECT clip_id, c, avg(p) AS m, count(*) AS n FROM (SELECT clip_id, unnest(range(5)) AS c, unnest(p) AS p FROM {SCORES_SQL}) GROUP BY ALL) GROUP BY clip_id)"""
TOPK_SQL = f"""(SELECT clip_id, arg_min(c, (-m, c)) AS pred_topk_mean FROM (
  SELECT clip_id, c, avg(p) AS m FROM (SELECT * FROM (SELECT clip_id, unnest(range(5)) AS c, unnest(p) AS p FROM {SCORES_SQL})
    QUALIFY row_number() OVER (PARTITION BY clip_id, c ORDER BY p DESC) <= {TOP_K}) GROUP BY ALL) GROUP BY clip_id)"""
VOTE_SQL = f"""(SELECT clip_id, arg_min(c, (-n, -m, c)) AS pred_majority_vote FROM (
  SELECT clip_id, c, avg(p) AS m, count(*) FILTER (WHERE vote = c) AS n FROM (
    SELECT clip_id, list_position(p, list_max(p)) - 1 AS vote, unnest(range(5)) AS c, unnest(p) AS p FROM {SCORES_SQL}) GROUP BY ALL) GROUP BY clip_id)"""
CLIP_PRED_SQL = f"""(SELECT clip_id, class_id, source_dataset, cents, coalesce(n_windows, 0) AS n_windows,
  CAST(pred_mean_softmax AS INTEGER) AS pred_mean_softmax, CAST(pred_topk_mean AS INTEGER) AS pred_topk_mean, CAST(pred_majority_vote AS INTEGER) AS pred_majority_vote
  FROM {CLIPS_SQL} LEFT JOIN {MEAN_SQL} USING (clip_id) LEFT JOIN {TOPK_SQL} USING (clip_id) LEFT JOIN {VOTE_SQL} USING (clip_id))"""


def clip_preds(spark, sf):
    return op.clip_predictions(scored_windows(spark, sf), truth(spark, sf), "clip_id", "p", K, TOP_K)


def mean_preds(spark, sf):
    """Truth and the mean-softmax prediction only."""
    mean = op.clip_mean_softmax(scored_windows(spark, sf), "clip_id", "p", K).drop("mean_p")
    return truth(spark, sf).join(mean, "clip_id", "left")


def confusion_sql(source: str, pred: str, true: str = "class_id") -> str:
    return f"""(SELECT t.true_id, t.pred_id, coalesce(n, 0) AS n FROM (SELECT CAST(i // 5 AS INTEGER) AS true_id, CAST(i % 5 AS INTEGER) AS pred_id FROM range(25) t(i)) t
      LEFT JOIN (SELECT {true} AS true_id, {pred} AS pred_id, count(*) AS n FROM {source} WHERE {pred} IS NOT NULL GROUP BY ALL) c
        ON c.true_id = t.true_id AND c.pred_id = t.pred_id)"""


def prf_sql(confusion: str) -> str:
    return f"""(SELECT class_id, support, tp, precision, recall, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
      FROM (SELECT a.class_id, support, tp, CASE WHEN predicted <> 0 THEN tp / predicted::DOUBLE ELSE 0.0::DOUBLE END AS precision,
          CASE WHEN support <> 0 THEN tp / support::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM
        (SELECT true_id AS class_id, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN true_id = pred_id THEN n ELSE 0 END) AS BIGINT) AS tp FROM {confusion} GROUP BY true_id) a
        JOIN (SELECT pred_id AS class_id, CAST(sum(n) AS BIGINT) AS predicted FROM {confusion} GROUP BY pred_id) b USING (class_id)))"""


METRIC_NAMES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def summary_sql(prf: str) -> str:
    avgs = ", ".join(f"round(avg({m}), 9) AS macro_{m}" for m in ("precision", "recall", "f1"))
    weighted = ", ".join(f"round(sum({m} * support) / sum(support), 9) AS weighted_{m}" for m in ("precision", "recall", "f1"))
    return f"""(SELECT CAST(sum(support) AS BIGINT) AS samples, CAST(sum(tp) AS BIGINT) AS correct,
      round(CAST(sum(tp) AS DOUBLE) / sum(support), 9) AS accuracy, {avgs}, {weighted} FROM {prf})"""


WINDOW_CONFUSION_SQL = confusion_sql(WINDOW_PRED_SQL, "pred_id")
CLIP_CONFUSION_SQL = confusion_sql(CLIP_PRED_SQL, "pred_mean_softmax")


def window_confusion(spark, sf):
    return op.confusion_matrix(window_predictions(spark, sf), "class_id", "pred_id", K)


def clip_confusion(spark, sf):
    scored = mean_preds(spark, sf).filter("pred_mean_softmax IS NOT NULL")
    return op.confusion_matrix(scored, "class_id", "pred_mean_softmax", K)


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("confusion_matrix", f"SELECT true_id, pred_id, n FROM {WINDOW_CONFUSION_SQL}")
def confusion_matrix(spark, sf):
    return window_confusion(spark, sf)


NAMES = [c.replace(" ", "_") for c in ORDER_CLASSES]


@query(
    "confusion_pivot",
    f"""SELECT ['{"','".join(NAMES)}'][true_id + 1] AS actual, {", ".join(f'CAST(sum(n) FILTER (WHERE pred_id = {i}) AS BIGINT) AS "{n}"' for i, n in enumerate(NAMES))}
        FROM {WINDOW_CONFUSION_SQL} GROUP BY true_id""",
)
def confusion_pivot(spark, sf):
    return op.confusion_pivot(window_confusion(spark, sf), NAMES)


@query(
    "per_class_prf",
    f"SELECT class_id, support, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM {prf_sql(WINDOW_CONFUSION_SQL)}",
)
def per_class_prf(spark, sf):
    return rounded(op.per_class_prf(window_confusion(spark, sf)), "precision", "recall", "f1")


@query("summary_metrics", f"SELECT * FROM {summary_sql(prf_sql(WINDOW_CONFUSION_SQL))}")
def summary_metrics(spark, sf):
    return rounded(op.summary_metrics(op.per_class_prf(window_confusion(spark, sf))), *METRIC_NAMES)


@query("clip_mean_softmax", f"SELECT clip_id, n_windows, CAST(pred_mean_softmax AS INTEGER) AS pred_mean_softmax FROM {MEAN_SQL}")
def clip_mean_softmax(spark, sf):
    return op.clip_mean_softmax(scored_windows(spark, sf), "clip_id", "p", K).drop("mean_p")


@query("clip_topk_mean", f"SELECT clip_id, CAST(pred_topk_mean AS INTEGER) AS pred_topk_mean FROM {TOPK_SQL}")
def clip_topk_mean(spark, sf):
    return op.clip_topk_mean(scored_windows(spark, sf), "clip_id", "p", K, TOP_K)


@query("clip_majority_vote", f"SELECT clip_id, CAST(pred_majority_vote AS INTEGER) AS pred_majority_vote FROM {VOTE_SQL}")
def clip_majority_vote(spark, sf):
    return op.clip_majority_vote(scored_windows(spark, sf), "clip_id", "p", K)


@query(
    "top_confusions",
    f"""SELECT ['{"','".join(NAMES)}'][true_id + 1] AS actual, ['{"','".join(NAMES)}'][pred_id + 1] AS predicted, n AS count, round(n / t::DOUBLE, 9) AS rate
        FROM (SELECT *, sum(n) OVER (PARTITION BY true_id) AS t FROM {CLIP_CONFUSION_SQL}) WHERE true_id <> pred_id AND n > 0
        ORDER BY n DESC, actual, predicted LIMIT 15""",
)
def top_confusions(spark, sf):
    return rounded(op.top_confusions(clip_confusion(spark, sf), NAMES), "rate")


@query(
    "subgroup_recall",
    f"""SELECT bucket, count(*) AS total, count(pred_mean_softmax) AS assessed, count(*) FILTER (WHERE pred_mean_softmax = 1) AS correct,
          CASE WHEN count(pred_mean_softmax) <> 0 THEN count(*) FILTER (WHERE pred_mean_softmax = 1) / count(pred_mean_softmax)::DOUBLE ELSE 0 END AS recall
        FROM (SELECT *, CASE WHEN cents < 20000000 THEN 'below' ELSE 'at_or_above' END AS bucket FROM {CLIP_PRED_SQL} WHERE class_id = 1) GROUP BY bucket""",
)
def subgroup_recall(spark, sf):
    return op.subgroup_recall(mean_preds(spark, sf), "class_id", "pred_mean_softmax", 1, "cents", 20000000)


DOMINANT_SQL = f"(SELECT class_id, arg_min(source_dataset, (-n, source_dataset)) AS dominant FROM (SELECT class_id, source_dataset, count(*) AS n FROM {CLIPS_SQL} GROUP BY ALL) GROUP BY class_id)"


@query("dominant_source", f"SELECT class_id, dominant FROM {DOMINANT_SQL}")
def dominant_source(spark, sf):
    return op.dominant_source(truth(spark, sf), "class_id", "source_dataset")


@query(
    "within_cross_errors",
    f"""SELECT e.class_id AS true_id, e.pred_mean_softmax AS pred_id, CASE WHEN a.dominant IS NULL OR b.dominant IS NULL THEN 'unclassifiable'
          WHEN a.dominant = b.dominant THEN 'within' ELSE 'cross' END AS error_kind, count(*) AS clips
        FROM {CLIP_PRED_SQL} e LEFT JOIN (SELECT * FROM {DOMINANT_SQL} WHERE class_id <> 4) a ON a.class_id = e.class_id
        LEFT JOIN (SELECT * FROM {DOMINANT_SQL} WHERE class_id <> 4) b ON b.class_id = e.pred_mean_softmax
        WHERE e.pred_mean_softmax <> e.class_id GROUP BY ALL""",
)
def within_cross_errors(spark, sf):
    rows = mean_preds(spark, sf)
    # Class 4 is left without a known source, to reach every kind of error.
    dominant = op.dominant_source(truth(spark, sf), "class_id", "source_dataset").filter("class_id <> 4")
    return op.within_cross_errors(rows, "class_id", "pred_mean_softmax", dominant, "class_id")


@query(
    "recall_by_source",
    f"""SELECT class_id, source_dataset, count(*) AS n, count(*) FILTER (WHERE pred_mean_softmax = class_id) AS correct,
          round(count(*) FILTER (WHERE pred_mean_softmax = class_id) / count(*)::DOUBLE, 9) AS recall
        FROM {CLIP_PRED_SQL} WHERE pred_mean_softmax IS NOT NULL AND class_id IN (SELECT class_id FROM {CLIP_PRED_SQL}
          WHERE pred_mean_softmax IS NOT NULL GROUP BY class_id HAVING count(DISTINCT source_dataset) > 1) GROUP BY ALL""",
)
def recall_by_source(spark, sf):
    return rounded(op.recall_by_source(mean_preds(spark, sf), "class_id", "pred_mean_softmax", "source_dataset"), "recall")


REFERENCE = "l_returnflag = 'R'"


@query(
    "restrict_common_set",
    f"""SELECT class_id, count(*) FILTER (WHERE clip_id IN (SELECT l_orderkey FROM lineitem WHERE {REFERENCE})) AS kept, count(*) AS total,
          count(*) FILTER (WHERE clip_id IN (SELECT l_orderkey FROM lineitem WHERE {REFERENCE}) AND pred_mean_softmax = class_id) AS correct
        FROM {CLIP_PRED_SQL} GROUP BY class_id""",
)
def restrict_common_set(spark, sf):
    rows = mean_preds(spark, sf)
    reference = table(spark, sf, "lineitem").filter(REFERENCE).select(F.col("l_orderkey").alias("clip_id"))
    kept = op.restrict_common_set(rows, reference, "clip_id")
    hits = kept.groupBy("class_id").agg(F.count_if(F.col("pred_mean_softmax") == F.col("class_id")).alias("correct"))
    return op.restriction_counts(rows, reference, "clip_id", "class_id").join(hits, "class_id")


def _level_sql(level: str, source: str, pred: str) -> str:
    return f"SELECT '{level}' AS level, * FROM {summary_sql(prf_sql(confusion_sql(source, pred)))}"


@query(
    "level_comparison",
    " UNION ALL ".join(
        [_level_sql("window", WINDOW_PRED_SQL, "pred_id")]
        + [_level_sql(f"clip_{p}", CLIP_PRED_SQL, f"pred_{p}") for p in ("mean_softmax", "topk_mean", "majority_vote")]
    ),
)
def level_comparison(spark, sf):
    out = op.level_comparison(window_predictions(spark, sf), clip_preds(spark, sf), "class_id", "pred_id", K)
    return rounded(out, *METRIC_NAMES)


@query("clip_predictions", f"SELECT clip_id, class_id, n_windows, pred_mean_softmax, pred_topk_mean, pred_majority_vote FROM {CLIP_PRED_SQL}")
def clip_predictions(spark, sf):
    return clip_preds(spark, sf).drop("source_dataset", "cents")
