"""The fitted heads: all classes and features in the queries; one feature and two classes against Newton steps in SQL."""

import oracle
import pytest
from pyspark.sql import functions as F

from auricle.operators import diagnostics
from auricle.operators import models as op
from auricle.plans import load
from auricle.plans.diagnostics import CENTROID_SQL, VECTORS_SQL, vectors
from auricle.plans.models import SCALED_VECTORS_SQL, scaled_vectors

HALVES_SQL = f"(SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, split, scaled[1] AS x FROM {SCALED_VECTORS_SQL})"


def halves(spark, sf):
    return scaled_vectors(spark, sf).select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("label"), "split", F.slice("scaled", 1, 1).alias("scaled")
    )


def newton_sql(name: str, rows: str, penalty: float) -> str:
    """(b, w) that minimise sum of m * logistic loss of (b + w x, y) + penalty / 2 * w ** 2, as a table ``name``."""
    return f"""{name}_it AS (SELECT 0 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w UNION ALL
      SELECT k + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw), w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw) FROM (
        SELECT k, b, w, sum(m * (p - y)) AS gb, sum(m * (p - y) * x) + {penalty} * w AS gw, sum(m * p * (1 - p)) AS hbb,
          sum(m * p * (1 - p) * x) AS hbw, sum(m * p * (1 - p) * x * x) + {penalty} AS hww
        FROM (SELECT i.*, r.x, r.y, r.m, 1 / (1 + exp(-(b + w * x))) AS p FROM {name}_it i, {rows} r) GROUP BY k, b, w) WHERE k < 20),
      {name} AS (SELECT b, w FROM {name}_it ORDER BY k DESC LIMIT 1)"""


def held_out(model, rows, features, digits=5):
    return op.predict(model, rows.filter("split <> 'train'"), features).select(
        "vec_id", "label", "split", "prediction", F.round(F.col("probabilities")[1], digits).alias("p1")
    )


LOGISTIC_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, 1 AS m FROM {HALVES_SQL}), t AS (SELECT * FROM d WHERE split = 'train'), {newton_sql("f", "t", 0.5)}
        SELECT vec_id, y AS label, split, CASE WHEN b + w * x > 0 THEN 1 ELSE 0 END AS prediction, round(1 / (1 + exp(-(b + w * x))), 5) AS p1
        FROM d, f WHERE split <> 'train'"""


def logistic_head(spark, sf):
    rows = halves(spark, sf)
    model = op.logistic_head(rows.filter("split = 'train'"), "scaled", "label", c=1.0, max_iter=200, tol=1e-12)
    return held_out(model, rows, "scaled")


NEAREST_SQL = f"""(SELECT vec_id, label, arg_min(c_label, (dist, c_label)) AS nearest FROM (SELECT w.vec_id, w.label, c.label AS c_label,
    round(list_sum(list_transform(range(1, 65), lambda i: (w.embedding[i]::DOUBLE - c.centroid[i]) ** 2)), 9) AS dist
  FROM {VECTORS_SQL} w, {CENTROID_SQL} c WHERE w.split <> 'train') GROUP BY vec_id, label)"""
MLP_SQL = f"""SELECT CAST(label AS INTEGER) AS label, count(*) AS n, count(*) FILTER (WHERE nearest = label) AS nearest_correct,
          sum(count(*) FILTER (WHERE nearest = label)) OVER () >= 0.5::DOUBLE * sum(count(*)) OVER () AS separable, TRUE AS reaches_floor
        FROM {NEAREST_SQL} GROUP BY label"""


def mlp_head(spark, sf):
    """Held-out rows of each class, those the nearest centroid gets right, and whether the perceptron gets at
    least 0.8 times as many right in all."""
    rows = scaled_vectors(spark, sf)
    model = op.mlp_head(rows.filter("split = 'train'"), "scaled", "label", 32, 64, 10, seed=42, max_iter=100)
    hits = op.predict(model, rows.filter("split <> 'train'"), "scaled").select("vec_id", "prediction")
    raw = vectors(spark, sf)
    centroids = diagnostics.class_centroids(raw, "embedding", "label")
    near = nearest_centroid(raw.filter("split <> 'train'"), centroids)
    counted = near.join(hits, "vec_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("nearest") == F.col("label")).alias("nearest_correct"),
        F.count_if(F.col("prediction") == F.col("label")).alias("_hits"),
    )
    whole = counted.agg(F.sum("n").alias("_n"), F.sum("nearest_correct").alias("_near"), F.sum("_hits").alias("_all"))
    return counted.crossJoin(F.broadcast(whole)).select(  # one row
        F.col("label").cast("int").alias("label"),
        "n",
        "nearest_correct",
        (F.col("_near") >= 0.5 * F.col("_n")).alias("separable"),
        (F.col("_all") >= 0.8 * F.col("_near")).alias("reaches_floor"),
    )


def nearest_centroid(rows, centroids):
    """The class whose centroid is nearest, by squared distance; ten centroids are one row."""
    pairs = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))

    def distance(c):
        return F.round(
            F.aggregate(
                F.zip_with("embedding", c["centroid"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                F.lit(0.0),
                lambda a, x: a + x,
            ),
            9,
        )

    scored = F.transform("_c", lambda c: F.struct(distance(c).alias("dist"), c["label"].alias("label")))
    return rows.crossJoin(F.broadcast(pairs)).select("vec_id", "label", F.array_min(scored)["label"].alias("nearest"))


STACK_SQL = f"""WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM {HALVES_SQL}), n AS (SELECT count(*) AS t, sum(y) AS p FROM h WHERE split = 'train'),
        d AS (SELECT vec_id, split, x, 1 - y AS y, y AS label, CASE WHEN y = 1 THEN t / (2.0::DOUBLE * p) ELSE t / (2.0::DOUBLE * (t - p)) END AS m FROM h, n),
        t1 AS (SELECT * FROM d WHERE split = 'train'), {newton_sql("f", "t1", 1.0)},
        z AS MATERIALIZED (SELECT vec_id, label, split, label AS y, 1 AS m, 1 / (1 + exp(-(b + w * d.x))) AS x FROM d, f),
        t2 AS (SELECT * FROM z WHERE split = 'train'), {newton_sql("g", "t2", 0.25)}
        SELECT vec_id, label, split, CASE WHEN b + w * x > 0 THEN 1 ELSE 0 END AS prediction, round(1 / (1 + exp(-(b + w * x))), 4) AS p1
        FROM z, g WHERE split <> 'train'"""


def binary_stack_head(spark, sf):
    stacked = op.binary_stack_outputs(halves(spark, sf), "scaled", "label", 2, max_iter=200, tol=1e-12)
    model = op.stack_head(stacked.filter("split = 'train'"), "stack", "label", 2, c=1.0, max_iter=500, tol=1e-14)
    return held_out(model, stacked, "stack", 4)


@pytest.mark.parametrize("fn, sql", [(logistic_head, LOGISTIC_SQL), (mlp_head, MLP_SQL), (binary_stack_head, STACK_SQL)])
def test_head_equals_its_sql(spark, sf, fn, sql):
    assert oracle.compare(spark, oracle.connect(sf), sf, fn, sql) is None


@pytest.mark.parametrize("name", ["logistic_head", "mlp_head", "binary_stack_head"])
def test_query_predicts_each_held_out_row(spark, sf, name):
    got = {r.vec_id: r for r in load()[0][name](spark, sf).collect()}
    raw = vectors(spark, sf)
    rows = raw.filter("split <> 'train'").collect()
    assert set(got) == {r.vec_id for r in rows} and len(got) == len(rows)
    assert all((got[r.vec_id].label, got[r.vec_id].split) == (r.label, r.split) for r in rows)
    assert {r.prediction for r in got.values()} == set(range(10))
    assert all(0.1 <= r.confidence <= 1 for r in got.values())
    near = nearest_centroid(raw.filter("split <> 'train'"), diagnostics.class_centroids(raw, "embedding", "label"))
    hits = near.filter("nearest = label").count()
    assert sum(r.prediction == r.label for r in got.values()) >= 0.8 * hits
