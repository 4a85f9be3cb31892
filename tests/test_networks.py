"""The rectified head: gradients against differences, dropout, early stop, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import models, networks
from auricle.operators.checks import DataContractError
from auricle.operators.networks import NetworkSettings
from auricle.plans.models import scaled_vectors


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    net = networks.initial(5, 7, 3, seed=2)
    net = net.like(net.flat() + r.normal(0, 0.3, len(net.flat())))
    x, y, w = r.normal(size=(11, 5)), r.integers(0, 3, 11), r.uniform(0.5, 2, 11)
    for kept in (None, networks.dropout_mask(np.arange(11), 7, step=4, rate=0.4, seed=1)):
        got, flat, far = net.gradient(x, y, w, kept), net.flat(), 1e-6
        for i in range(len(flat)):
            up, down = flat.copy(), flat.copy()
            up[i] += far
            down[i] -= far
            want = (net.like(up).loss(x, y, w, kept) - net.like(down).loss(x, y, w, kept)) / (2 * far)
            assert got[i] == pytest.approx(want, abs=1e-5)


def test_dropout_is_a_function_of_row_step_and_unit():
    keys = np.arange(-1000, 1000)
    a = networks.dropout_mask(keys, 50, 3, 0.3, 1)
    assert (a == networks.dropout_mask(keys, 50, 3, 0.3, 1)).all()
    assert (a[::-1] == networks.dropout_mask(keys[::-1], 50, 3, 0.3, 1)).all()
    assert set(np.unique(a)) == {0.0, 1 / 0.7}
    assert a.mean() == pytest.approx(1, abs=0.02) and np.abs(a.mean(axis=0) - 1).max() < 0.12
    for other in (networks.dropout_mask(keys, 50, 4, 0.3, 1), networks.dropout_mask(keys, 50, 3, 0.3, 2)):
        assert 0.3 < (a != other).mean() < 0.55
    assert networks.dropout_mask(keys, 50, 3, 0.0, 1) is None


def rings(spark, n=600):
    """Three classes by the distance from the middle: no linear head can tell them apart."""
    r = np.random.default_rng(5)
    label = r.integers(0, 3, n)
    angle, far = r.uniform(0, 2 * np.pi, n), label + r.uniform(0.2, 0.8, n)
    rows = [
        (i, [float(d * np.cos(a)), float(d * np.sin(a))], int(c), "train" if i % 4 else ("val" if i % 8 else "test"))
        for i, (a, d, c) in enumerate(zip(angle, far, label))
    ]
    return spark.createDataFrame(rows, "id long, x array<double>, label int, split string")


def test_learns_what_a_linear_head_cannot(spark):
    rows = rings(spark)
    s = NetworkSettings(hidden=32, dropout=0.1, epochs=40, batches=2, learning_rate=0.03, patience=40)
    net = networks.fit_network(rows, "x", "label", "id", 3, s)
    losses = [h["val_loss"] for h in net.history]
    assert len(losses) <= 40 and min(losses) < 0.6 * losses[0]
    held = rows.filter("split = 'test'")
    hits = networks.predict(net, held, "x").filter("prediction = label").count() / held.count()
    linear = models.logistic_head(rows.filter("split = 'train'"), "x", "label")
    assert hits > 0.8 > models.predict(linear, held, "x").filter("prediction = label").count() / held.count()
    # The best epoch's weights are kept: the same loss on the validation rows.
    val = [(r.x, r.label) for r in rows.filter("split = 'val'").collect()]
    x, y = np.array([a for a, _ in val]), np.array([b for _, b in val])
    assert net.loss(x, y, np.ones(len(y))) / len(y) == pytest.approx(min(losses), rel=1e-9)


def test_the_split_of_rows_into_tasks_changes_nothing(spark, monkeypatch):
    rows = rings(spark, 200)
    s = NetworkSettings(hidden=4, epochs=3, batches=2, patience=1, rate_patience=1)
    one = networks.fit_network(rows.coalesce(1), "x", "label", "id", 3, s)
    monkeypatch.setattr(networks, "FAN", 1)  # two levels of sums
    many = networks.fit_network(rows.repartition(7), "x", "label", "id", 3, s)
    assert np.abs(one.flat() - many.flat()).max() < 1e-9
    assert [h["learning_rate"] for h in one.history] == [h["learning_rate"] for h in many.history]


def test_stops_early_and_lowers_the_rate(spark):
    rows = rings(spark, 120).withColumn("label", (F.xxhash64("id") % 3 + 2).cast("int") % 3)  # nothing to learn
    net = networks.fit_network(rows, "x", "label", "id", 3, NetworkSettings(hidden=16, epochs=30, batches=1, patience=3, rate_patience=1, learning_rate=0.3, dropout=0.0))
    assert len(net.history) < 30
    assert net.history[-1]["learning_rate"] < 0.3


def test_awkward_rows(spark):
    rows = rings(spark, 60)
    odd = spark.createDataFrame([(900, None, 1, "train"), (901, [0.0, 0.0], None, "train"), (902, [0.0, 0.0], 9, "val")], rows.schema)
    s = NetworkSettings(hidden=2, epochs=1)
    a, b = (networks.fit_network(d, "x", "label", "id", 3, s) for d in (rows, rows.union(odd)))
    assert np.abs(a.flat() - b.flat()).max() < 1e-12
    out = {r.id: r for r in networks.predict(a, rows.union(odd), "x").collect()}
    assert out[900].prediction is None and out[901].prediction is not None and sum(out[902].probabilities) == pytest.approx(1)
    with pytest.raises(DataContractError, match=r"\[2\]"):
        networks.fit_network(rows.filter("label <> 2"), "x", "label", "id", 3, s)
    with pytest.raises(DataContractError, match="validation"):
        networks.fit_network(rows.filter("split <> 'val'"), "x", "label", "id", 3, s)


def test_not_worse_than_the_perceptron(spark):
    """Held out at sf0.01, against sigmoid units without dropout, class weights and early stop."""
    rows = scaled_vectors(spark, "/root/testdata/sf0.01").cache()
    held = rows.filter("split <> 'train'")
    net = networks.fit_network(rows, "scaled", "label", "vec_id", 10)
    mine = networks.predict(net, held, "scaled").filter("prediction = label").count()
    other = models.mlp_head(rows.filter("split = 'train'"), "scaled", "label", 32, 64, 10, seed=42)
    assert mine >= models.predict(other, held, "scaled").filter("prediction = label").count()
    rows.unpersist()
