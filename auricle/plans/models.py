"""Embedding and model queries; the linear head's coefficients are the class centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import models as op
from ..operators import networks
from ..operators.windows import frame_windows
from .diagnostics import CENTROID_SQL, DIGITS, VECTORS_SQL, vectors
from .evaluation import METRIC_NAMES, WINDOW_CONFUSION_SQL, CLIP_CONFUSION_SQL, clip_confusion, prf_sql, summary_sql, window_confusion
from .fixtures import CLIPS_SQL, ORDER_CLASSES, clips, hash_split, hash_split_sql, signals, taxonomy, taxonomy_sql
from .registry import query, table
from .windows import FRAMES_SQL
from ..operators import diagnostics, evaluation


@query(
    "embedding_pool",
    f"""SELECT clip_id, count(*) AS n_frames, CAST(pos AS INTEGER) AS pos, round(avg(x), 8) + 0.0 AS mean, round(stddev_pop(x), 8) AS std
        FROM (SELECT clip_id, unnest(range(16)) AS pos, unnest(frame)::DOUBLE AS x FROM {FRAMES_SQL}) GROUP BY clip_id, pos""",
)
def embedding_pool(spark, sf):
    frames = frame_windows(signals(spark, sf), "samples", 16, 8)
    pooled = op.embedding_pool(frames, "clip_id", "frame")
    return pooled.select(
        "clip_id", "n_frames", F.posexplode(F.arrays_zip("embed_mean", "embed_std")).alias("pos", "z")
    ).select(
        "clip_id", "n_frames", "pos", F.round("z.embed_mean", 8).alias("mean"), F.round("z.embed_std", 8).alias("std")
    )


def faulty_index(spark, sf):
    rows = vectors(spark, sf).select(
        "vec_id",
        F.when(F.col("vec_id") % 53 == 2, 12).otherwise(F.col("label")).alias("class_id"),
        F.when(F.col("vec_id") % 59 == 3, "holdout").otherwise(F.col("split")).alias("split"),
        F.when(F.col("vec_id") % 61 == 4, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"),
    )
    doubled = rows.filter("vec_id % 47 = 1")
    foreign = rows.filter("vec_id % 43 = 6").withColumn("vec_id", F.col("vec_id") + 1000000)
    return rows.filter("vec_id % 41 <> 5").unionByName(doubled).unionByName(foreign)


FAULTY_INDEX_SQL = f"""(WITH r AS (SELECT vec_id, CASE WHEN vec_id % 53 = 2 THEN 12 ELSE label END AS class_id,
    CASE WHEN vec_id % 59 = 3 THEN 'holdout' ELSE split END AS split, CASE WHEN vec_id % 61 = 4 THEN 63 ELSE 64 END AS dim FROM {VECTORS_SQL})
  SELECT * FROM r WHERE vec_id % 41 <> 5 UNION ALL SELECT * FROM r WHERE vec_id % 47 = 1
  UNION ALL SELECT vec_id + 1000000, class_id, split, dim FROM r WHERE vec_id % 43 = 6)"""


@query(
    "embedding_index_check",
    f"""WITH g AS (SELECT vec_id, count(*) AS n, min(class_id) AS class_id, min(split) AS split, count(*) FILTER (WHERE dim <> 64) AS d,
          count(*) FILTER (WHERE class_id NOT BETWEEN 0 AND 9) AS c, count(*) FILTER (WHERE split NOT IN ('train','val','test')) AS s FROM {FAULTY_INDEX_SQL} GROUP BY vec_id),
        j AS (SELECT w.vec_id AS w, w.label AS wc, w.split AS ws, g.* FROM {VECTORS_SQL} w FULL OUTER JOIN g ON g.vec_id = w.vec_id)
        SELECT count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE w IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS repeated,
          count(*) FILTER (WHERE wc <> class_id) AS class_differs, count(*) FILTER (WHERE ws <> split) AS split_differs,
          CAST(sum(d) AS BIGINT) AS wrong_dimension, CAST(sum(c) AS BIGINT) AS class_out_of_range, CAST(sum(s) AS BIGINT) AS split_out_of_range FROM j""",
)
def embedding_index_check(spark, sf):
    expected = vectors(spark, sf).select("vec_id", F.col("label").alias("class_id"), "split")
    return op.embedding_index_check(
        faulty_index(spark, sf), expected, "vec_id", "embedding", 64, 10, ("train", "val", "test")
    )


SCALER_SQL = f"""(SELECT list(m ORDER BY pos) AS mean, list(s ORDER BY pos) AS scale FROM (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (
  SELECT unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM {VECTORS_SQL} WHERE split = 'train') GROUP BY pos))"""
SCALED_VECTORS_SQL = f"""(SELECT vec_id, label, split, list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - mean[i]) / scale[i]) AS scaled
  FROM {VECTORS_SQL}, {SCALER_SQL})"""


def scaler(spark, sf):
    return op.Scaler.fit(vectors(spark, sf).filter("split = 'train'"), "embedding")


def scaled_vectors(spark, sf):
    return scaler(spark, sf).apply(vectors(spark, sf), "embedding", "scaled")


@query(
    "standard_scale",
    f"""SELECT vec_id, split, round(list_sum(scaled), 7) + 0.0 AS total, round(list_min(scaled), 7) AS lo, round(list_max(scaled), 7) AS hi,
          round(scaled[64], 7) + 0.0 AS last FROM {SCALED_VECTORS_SQL}""",
)
def standard_scale(spark, sf):
    return scaled_vectors(spark, sf).select(
        "vec_id",
        "split",
        F.round(v.total("scaled"), 7).alias("total"),
        F.round(F.array_min("scaled"), 7).alias("lo"),
        F.round(F.array_max("scaled"), 7).alias("hi"),
        F.round(F.col("scaled")[63], 7).alias("last"),
    )


# The fitted heads have no twin: SQL has no optimizer for ten classes. tests/test_heads.py compares them with Newton
# steps on one feature and two classes, and with the nearest centroid.


def held_out(model, rows, features):
    return op.predict(model, rows.filter("split <> 'train'"), features).select(
        "vec_id", "label", "split", "prediction", F.array_max("probabilities").alias("confidence")
    )


@query("logistic_head")
def logistic_head(spark, sf):
    rows = scaled_vectors(spark, sf)
    model = op.logistic_head(rows.filter("split = 'train'"), "scaled", "label", c=1.0, max_iter=200)
    return held_out(model, rows, "scaled")


@query("mlp_head")
def mlp_head(spark, sf):
    """Rectified units with dropout and class weights, stopped early by the validation loss."""
    rows = scaled_vectors(spark, sf)
    net = networks.fit_network(rows, "scaled", "label", "vec_id", 10)
    return networks.predict(net, rows.filter("split <> 'train'"), "scaled").select(
        "vec_id", "label", "split", "prediction", F.array_max("probabilities").alias("confidence")
    )


@query("binary_stack_head")
def binary_stack_head(spark, sf):
    stacked = op.binary_stack_outputs(scaled_vectors(spark, sf), "scaled", "label", 10, max_iter=200)
    model = op.stack_head(stacked.filter("split = 'train'"), "stack", "label", 10, c=1.0, max_iter=500)
    return held_out(model, stacked, "stack")


OWN = ("Low", "Middle", "High", "Wide")
MAPPING = {"Low": (0, 1, 2), "Middle": (30,), "High": (60, 61, 62, 63)}


@query(
    "zero_shot_scores",
    """SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS index, ['Low','Middle','High','Wide'][list_position(s, list_max(s))] AS label,
         list_max(s) AS score, 'Wide' AS unmapped FROM (
         SELECT vec_id, [0.0::DOUBLE + embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE, 0.0::DOUBLE + embedding[31]::DOUBLE,
           0.0::DOUBLE + embedding[61]::DOUBLE + embedding[62]::DOUBLE + embedding[63]::DOUBLE + embedding[64]::DOUBLE, 0.0::DOUBLE] AS s FROM embeddings)""",
)
def zero_shot_scores(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("scores", op.zero_shot_scores("embedding", MAPPING, OWN))
    best = op.argmax_label("scores", OWN)
    return rows.select(
        "vec_id",
        best["index"].alias("index"),
        best["label"].alias("label"),
        best["confidence"].alias("score"),
        F.lit(",".join(op.unmapped_classes(MAPPING, OWN))).alias("unmapped"),
    )


def centroid_head(spark, sf):
    """Linear head: coefficients are 20 times the class centroids, intercept label / 100."""
    c = diagnostics.class_centroids(vectors(spark, sf), "embedding", "label")
    coefficients = c.select(
        F.col("label").alias("class_id"),
        (F.col("label") / 100.0).alias("intercept"),
        F.transform("centroid", lambda x: x * 20.0).alias("coef"),
    )
    return op.LinearHead.load(coefficients, scaler(spark, sf))


LOGITS_SQL = f"""(SELECT vec_id, list(z ORDER BY label) AS z FROM (
  SELECT v.vec_id, c.label, list_sum(list_transform(list_zip(v.scaled, c.centroid), lambda q: q[1] * q[2] * 20)) + c.label / 100.0::DOUBLE AS z
  FROM {SCALED_VECTORS_SQL} v, {CENTROID_SQL} c) GROUP BY vec_id)"""
PROBS_SQL = f"""(SELECT vec_id, list_transform(e, lambda x: x / s) AS p FROM (SELECT vec_id, e, list_sum(e) AS s FROM (
  SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM {LOGITS_SQL})))"""


def probabilities(spark, sf):
    return centroid_head(spark, sf).score(table(spark, sf, "embeddings"), "embedding")


@query(
    "linear_head_score",
    f"SELECT vec_id, CAST(unnest(range(10)) AS INTEGER) AS class_id, round(unnest(p), 8) AS p FROM {PROBS_SQL}",
)
def linear_head_score(spark, sf):
    return probabilities(spark, sf).select("vec_id", F.posexplode("probabilities").alias("class_id", "p")).withColumn(
        "p", F.round("p", 8)
    )


@query(
    "argmax_label",
    f"""SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS index, 'c' || (list_position(p, list_max(p)) - 1) AS label,
          round(list_max(p), 8) AS confidence FROM {PROBS_SQL}""",
)
def argmax_label(spark, sf):
    best = op.argmax_label("probabilities", DIGITS)
    return probabilities(spark, sf).select(
        "vec_id", best["index"].alias("index"), best["label"].alias("label"), F.round(best["confidence"], 8).alias("confidence")
    )


@query(
    "topk_labels",
    f"""SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) - 1 AS INTEGER) AS rank, CAST(i AS INTEGER) AS index, 'c' || i AS label, round(p, 8) AS p
        FROM (SELECT vec_id, unnest(range(10)) AS i, unnest(p) AS p FROM {PROBS_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) <= 3""",
)
def topk_labels(spark, sf):
    return op.topk_labels(probabilities(spark, sf), "vec_id", "probabilities", DIGITS, 3).withColumn("p", F.round("p", 8))


@query(
    "model_contract_check",
    f"""SELECT coalesce(c.label, t.class_id) AS class_id, unnest(list_filter([CASE WHEN c.label IS NULL THEN 'class_missing' END, CASE WHEN t.class_id IS NULL THEN 'class_unknown' END,
          CASE WHEN c.label = 3 THEN 'name_differs' END, CASE WHEN c.label = 5 THEN 'wrong_dimension' END], lambda x: x IS NOT NULL)) AS problem
        FROM (SELECT DISTINCT CASE WHEN label = 7 THEN 17 ELSE label END AS label FROM embeddings WHERE label <> 2) c
        FULL OUTER JOIN {taxonomy_sql(DIGITS)} t ON t.class_id = c.label""",
)
def model_contract_check(spark, sf):
    c = diagnostics.class_centroids(
        table(spark, sf, "embeddings").withColumn("split", F.lit("train")).filter("label <> 2"), "embedding", "label"
    )
    class_id = F.when(F.col("label") == 7, 17).otherwise(F.col("label"))
    coefficients = c.select(
        class_id.alias("class_id"),
        F.when(F.col("label") == 3, "other").otherwise(F.concat(F.lit("c"), class_id)).alias("class_name"),
        F.when(F.col("label") == 5, F.slice("centroid", 1, 60)).otherwise(F.col("centroid")).alias("coef"),
    )
    return op.model_contract_check(coefficients, taxonomy(spark, DIGITS), 64)


@query(
    "batch_score_quarantine",
    f"""SELECT v.vec_id, CASE WHEN v.vec_id % 31 IN (3, 5, 7) THEN NULL ELSE CAST(list_position(z, list_max(z)) - 1 AS INTEGER) END AS prediction,
          CASE v.vec_id % 31 WHEN 3 THEN 'missing' WHEN 5 THEN 'dimension 10 != 64' WHEN 7 THEN 'non-finite value' END AS error
        FROM embeddings v JOIN {LOGITS_SQL} USING (vec_id)""",
)
def batch_score_quarantine(spark, sf):
    kind = F.col("vec_id") % 31
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(kind == 3, F.lit(None))
        .when(kind == 5, F.slice("embedding", 1, 10))
        .when(kind == 7, F.array_append(F.slice("embedding", 1, 63), F.lit(float("nan")).cast("float")))
        .otherwise(F.col("embedding"))
        .alias("embedding"),
    )
    return op.batch_score_quarantine(rows, "vec_id", "embedding", centroid_head(spark, sf))


@query(
    "pool_sample",
    f"""WITH v AS (SELECT clip_id FROM {CLIPS_SQL} WHERE {hash_split_sql('clip_id')} = 'val'),
        k AS (SELECT clip_id, project_class FROM {CLIPS_SQL} WHERE cents >= 5000000)
        SELECT 'sample' AS kind, clip_id FROM (SELECT clip_id FROM k WHERE clip_id IN (SELECT clip_id FROM v)
          ORDER BY md5('7:' || clip_id), clip_id LIMIT 50)
        UNION ALL SELECT 'unmatched', clip_id FROM v WHERE clip_id NOT IN (SELECT clip_id FROM k)""",
)
def pool_sample(spark, sf):
    rows = clips(spark, sf)
    splits = rows.select("clip_id", hash_split("clip_id").alias("split"))
    ledger = rows.select("clip_id", "project_class", F.when(F.col("cents") >= 5000000, "kept").otherwise("excluded").alias("status"))
    sample, unmatched = op.pool_sample(splits, ledger, "clip_id", 50, seed=7)
    return sample.select(F.lit("sample").alias("kind"), "clip_id").unionByName(
        unmatched.select(F.lit("unmatched").alias("kind"), "clip_id")
    )


SHOWN = "o_orderkey % 2 = 0 AND o_orderpriority <> '3-MEDIUM'"
PREDICTED_SQL = "CASE WHEN o_custkey % 17 = 3 THEN NULL WHEN o_custkey % 3 = 0 THEN '1-URGENT' WHEN o_custkey % 7 = 1 THEN '2-HIGH' ELSE o_orderpriority END"


@query(
    "class_scoreboard",
    f"""WITH s AS (SELECT o_orderpriority AS class_name, {PREDICTED_SQL} AS predicted FROM orders WHERE {SHOWN}),
        t AS {taxonomy_sql([*ORDER_CLASSES, "6-NONE"])},
        r AS (SELECT t.class_name, (SELECT count(*) FROM orders WHERE o_orderpriority = t.class_name) AS pool,
            (SELECT count(*) FROM s WHERE s.class_name = t.class_name) AS shown, (SELECT count(*) FROM s WHERE s.class_name = t.class_name AND predicted = s.class_name) AS correct,
            (SELECT count(*) FROM s WHERE s.class_name = t.class_name AND predicted <> s.class_name) AS wrong,
            (SELECT count(*) FROM s WHERE s.class_name = t.class_name AND predicted IS NULL) AS errors,
            (SELECT count(*) FROM s WHERE predicted = t.class_name AND predicted <> s.class_name) AS fp FROM t),
        m AS (SELECT *, correct / nullif(correct + wrong, 0)::DOUBLE AS accuracy, correct / nullif(correct + fp, 0)::DOUBLE AS precision,
            correct / nullif(correct + wrong, 0)::DOUBLE AS recall FROM r),
        f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM m)
        SELECT class_name, pool, shown, correct, wrong, errors, fp, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f
        UNION ALL SELECT 'TOTAL', CAST(sum(pool) AS BIGINT), CAST(sum(shown) AS BIGINT), CAST(sum(correct) AS BIGINT), CAST(sum(wrong) AS BIGINT), CAST(sum(errors) AS BIGINT), CAST(sum(fp) AS BIGINT),
          round(CAST(sum(correct) AS DOUBLE) / sum(shown), 9), round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM f""",
)
def class_scoreboard(spark, sf):
    orders = table(spark, sf, "orders")
    shown = orders.filter(SHOWN).select(F.col("o_orderpriority").alias("class_name"), F.expr(PREDICTED_SQL).alias("predicted"))
    pool = orders.select(F.col("o_orderpriority").alias("class_name"))
    out = op.class_scoreboard(pool, shown, taxonomy(spark, [*ORDER_CLASSES, "6-NONE"]))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "run_comparison",
    f"""WITH r AS (SELECT 'window' AS run, * FROM {summary_sql(prf_sql(WINDOW_CONFUSION_SQL))} UNION ALL SELECT 'clip', * FROM {summary_sql(prf_sql(CLIP_CONFUSION_SQL))})
        SELECT *, run = (SELECT run FROM r ORDER BY accuracy DESC, run LIMIT 1) AS best FROM r""",
)
def run_comparison(spark, sf):
    runs = {
        "window": evaluation.summary_metrics(evaluation.per_class_prf(window_confusion(spark, sf))),
        "clip": evaluation.summary_metrics(evaluation.per_class_prf(clip_confusion(spark, sf))),
    }
    return op.run_comparison(runs, "accuracy").withColumns({m: F.round(m, 9) for m in METRIC_NAMES})


@query(
    "metric_reproduction_check",
    f"""SELECT * FROM (SELECT 'accuracy' AS metric, 0.2::DOUBLE AS expected, accuracy AS actual, abs(accuracy - 0.2::DOUBLE) <= 0.05::DOUBLE AS ok FROM {summary_sql(prf_sql(WINDOW_CONFUSION_SQL))}
          UNION ALL SELECT 'macro_f1', 0.9::DOUBLE, macro_f1, abs(macro_f1 - 0.9::DOUBLE) <= 0.05::DOUBLE FROM {summary_sql(prf_sql(WINDOW_CONFUSION_SQL))}
          UNION ALL SELECT 'auc', 0.5::DOUBLE, NULL, FALSE)""",
)
def metric_reproduction_check(spark, sf):
    row = evaluation.summary_metrics(evaluation.per_class_prf(window_confusion(spark, sf)))
    pairs = [F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in ("accuracy", "macro_f1")]
    actual = row.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")
    expected = spark.createDataFrame([("accuracy", 0.2), ("macro_f1", 0.9), ("auc", 0.5)], "metric string, value double")
    return op.metric_reproduction_check(actual, expected, 0.05)
