"""Heads, scoring and scoreboards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import diagnostics, models
from auricle.operators import evaluation as ev
from auricle.operators.checks import DataContractError


@pytest.fixture(scope="module")
def blobs(spark):
    """Three separated classes in 6 dimensions."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        label = i % 3
        rows.append((i, label, "val" if i % 5 == 0 else "train", (rng.normal(size=6) + 4 * np.eye(6)[label]).tolist()))
    return spark.createDataFrame(rows, "id int, label int, split string, x array<double>")


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]


def test_scaler_uses_the_population_deviation(blobs):
    train = blobs.filter("split = 'train'")
    s = models.Scaler.fit(train, "x")
    x = np.array([r["x"] for r in train.collect()])
    assert np.allclose(s.mean, x.mean(axis=0)) and np.allclose(s.scale, x.std(axis=0))
    out = np.array([r["z"] for r in s.apply(train, "x", "z").orderBy("id").collect()])
    assert np.allclose(out.mean(axis=0), 0) and np.allclose(out.std(axis=0), 1)


@pytest.mark.parametrize("head", ["logistic", "mlp", "stack"])
def test_heads_learn_separated_classes(blobs, head):
    features = "x"
    rows = blobs
    if head == "stack":
        rows, features = models.binary_stack_outputs(blobs, "x", "label", 3), "stack"
    train = rows.filter("split = 'train'")
    if head == "mlp":
        model = models.mlp_head(train, features, "label", 8, 6, 3, seed=1)
    else:
        model = models.logistic_head(train, features, "label")
    out = models.predict(model, rows.filter("split = 'val'"), features)
    assert accuracy(out) > 0.95
    assert abs(out.first()["probabilities"][0] + sum(out.first()["probabilities"][1:]) - 1) < 1e-9


def test_logistic_head_minimises_the_penalised_loss(blobs):
    train = blobs.filter("split = 'train'")
    model = models.logistic_head(train, "x", "label", c=0.5, max_iter=200)
    x = np.array([r["x"] for r in train.collect()])
    y = np.array([r["label"] for r in train.collect()])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = 0.5 * (p - np.eye(3)[y]).T @ x + w  # of C * loss + |w|^2 / 2
    assert np.abs(gradient).max() < 0.05


def test_linear_head_and_quarantine(spark):
    coef = spark.createDataFrame([(0, 0.0, [1.0, 0.0]), (1, 0.5, [0.0, 1.0])], "class_id int, intercept double, coef array<double>")
    head = models.LinearHead.load(coef, models.Scaler(np.zeros(2), np.ones(2)))
    df = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "id int, x array<double>")
    out = {r["id"]: r["p"] for r in head.score(df, "x", "p").collect()}
    assert out[1] == pytest.approx([np.exp(3) / (np.exp(3) + np.exp(0.5)), np.exp(0.5) / (np.exp(3) + np.exp(0.5))])
    bad = spark.createDataFrame(
        [(1, [3.0, 0.0]), (2, None), (3, [1.0]), (4, [float("inf"), 0.0])], "id int, x array<double>"
    )
    got = {r["id"]: (r["prediction"], r["error"]) for r in models.batch_score_quarantine(bad, "id", "x", head).collect()}
    assert got == {1: (0, None), 2: (None, "missing"), 3: (None, "dimension 1 != 2"), 4: (None, "non-finite value")}


def test_parameter_tables_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i, [0.0] * 4) for i in range(5)], "k int, v array<double>")
    monkeypatch.setattr(models, "MAX_MATRIX_CELLS", 19)
    with pytest.raises(DataContractError, match="not a small matrix"):
        models.collect_matrix(df, "k", "v")
    with pytest.raises(DataContractError, match="empty"):
        models.collect_matrix(df.filter("k < 0"), "k", "v")


def test_margin_of_a_class_without_centroid_is_null(spark):
    df = spark.createDataFrame([(0, "train", [0.0, 0.0]), (1, "train", [2.0, 0.0]), (7, "val", [1.0, 0.0])], "label int, split string, x array<double>")
    c = diagnostics.class_centroids(df, "x", "label")
    out = {r["label"]: r["margin"] for r in diagnostics.centroid_margins(df, "x", "label", c).collect()}
    assert out == {0: 4.0, 1: 4.0, 7: None}


def test_class_weights_average_to_one(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "class_id int")
    tax = spark.createDataFrame([(0, "a"), (1, "b")], "class_id int, class_name string")
    rows = {r["class_id"]: r for r in diagnostics.class_weights(df, "class_id", tax).collect()}
    assert (rows[0]["weight"], rows[1]["weight"]) == (8 / 12, 2.0)
    assert (rows[1]["weight_one"], rows[1]["weight_rest"]) == (2.0, 8 / 12)
    wider = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, class_name string")
    with pytest.raises(DataContractError, match=r"\[2\]"):
        diagnostics.class_weights(df, "class_id", wider)


def test_scoreboard_total_averages_defined_rates(spark):
    tax = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, class_name string")
    shown = spark.createDataFrame([("a", "a"), ("a", None), ("b", "a")], "class_name string, predicted string")
    out = {r["class_name"]: r for r in models.class_scoreboard(shown.select("class_name"), shown, tax).collect()}
    assert out["a"]["errors"] == 1 and out["a"]["precision"] == 0.5 and out["a"]["recall"] == 1.0
    assert out["c"]["precision"] is None and out["b"]["f1"] is None
    assert out["TOTAL"]["recall"] == 0.5 and out["TOTAL"]["precision"] == 0.5


def windows_of(spark, clips):
    rows = [(c, i, p) for c, ps in clips.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "clip string, w int, p array<double>")


def test_vote_ties_go_to_the_higher_mean(spark):
    df = windows_of(spark, {"t": [[0.6, 0.4], [0.1, 0.9]], "u": [[0.5, 0.5]], "v": [[0.7, 0.3], [0.3, 0.7]]})
    got = {r["clip"]: r["pred_majority_vote"] for r in ev.clip_majority_vote(df, "clip", "p", 2).collect()}
    assert got == {"t": 1, "u": 0, "v": 0}


def test_topk_mean(spark):
    rng = np.random.default_rng(4)
    data = {f"c{i}": rng.dirichlet(np.ones(4), size=1 + 5 * i).tolist() for i in range(6)}
    out = ev.clip_topk_mean(windows_of(spark, data), "clip", "p", 4, 3).collect()
    for r in out:
        best = -np.sort(-np.array(data[r["clip"]]), axis=0)[:3].mean(axis=0)
        assert r["pred_topk_mean"] == best.argmax()
    assert len(out) == 6
    nulls = windows_of(spark, {"a": [[0.9, 0.05], [None, 0.5]], "b": [[0.1, None], [None, None]], "c": [[None, None]]})
    got = {r["clip"]: r["pred_topk_mean"] for r in ev.clip_topk_mean(nulls, "clip", "p", 2, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": None}


def test_predictions_outside_the_list_keep_the_support(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 7), (1, 0), (9, 0), (None, 1)], "t int, p int")
    cm = ev.confusion_matrix(df, "t", "p", 2)
    assert sorted((r.true_id, r.n) for r in cm.filter("pred_id IS NULL").collect()) == [(0, 1), (1, 1)]
    s = ev.summary_metrics(ev.per_class_prf(cm)).first()
    assert (s["samples"], s["correct"], s["accuracy"]) == (4, 1, 0.25)


def test_metrics_of_a_known_confusion(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 0)]
    df = spark.createDataFrame(rows, "t int, p int")
    cm = ev.confusion_matrix(df, "t", "p", 4)
    assert cm.count() == 16 and cm.agg(F.sum("n")).first()[0] == 7
    prf = {r["class_id"]: r for r in ev.per_class_prf(cm).collect()}
    assert prf[0]["precision"] == 0.75 and prf[0]["recall"] == 0.75 and prf[3]["f1"] == 0.0
    s = ev.summary_metrics(ev.per_class_prf(cm)).first()
    assert s["accuracy"] == pytest.approx(5 / 7)
    assert s["macro_f1"] == pytest.approx((0.75 + 0.8) / 4)
    assert s["weighted_recall"] == pytest.approx(s["accuracy"])
