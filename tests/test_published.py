"""Published results of the evaluated system, recomputed from their published counts."""

import pytest
from pyspark.sql import functions as F

from auricle.operators import diagnostics, gates
from auricle.operators import evaluation as ev

# Hits, support and predictions per class of one clip-level evaluation.
HITS = (23, 70, 50, 46, 95, 0, 64, 75, 13, 22, 45, 84, 21, 6, 126, 30, 38)
SUPPORT = (51, 120, 70, 146, 158, 8, 168, 87, 75, 122, 76, 148, 63, 35, 142, 80, 69)
PREDICTED = (64, 139, 50, 59, 172, 0, 91, 349, 14, 26, 84, 107, 23, 11, 144, 247, 38)


def matrix():
    """A confusion matrix with these margins; metrics depend on nothing else."""
    n = len(HITS)
    cells = {(i, i): HITS[i] for i in range(n)}
    rows, cols = [s - h for s, h in zip(SUPPORT, HITS)], [p - h for p, h in zip(PREDICTED, HITS)]
    # The class with the largest remaining margin goes first, so that no class meets itself at the end.
    while sum(rows):
        i = max((k for k in range(n) if rows[k]), key=lambda k: rows[k] + cols[k])
        j = max((k for k in range(n) if k != i and cols[k]), key=lambda k: rows[k] + cols[k])
        cells[i, j] = cells.get((i, j), 0) + 1
        rows[i], cols[j] = rows[i] - 1, cols[j] - 1
    return [(i, j, cells.get((i, j), 0)) for i in range(n) for j in range(n)]


def test_summary_and_class_metrics(spark):
    cm = spark.createDataFrame(matrix(), "true_id int, pred_id int, n long")
    prf = ev.per_class_prf(cm)
    s = ev.summary_metrics(prf).first()
    got = [s["samples"], s["correct"]] + [
        round(s[m], 6)
        for m in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")
    ]
    assert got == [1618, 808, 0.499382, 0.627270, 0.455241, 0.468914, 0.677418, 0.499382, 0.519276]
    rows = {r["class_id"]: r for r in prf.collect()}
    assert [round(rows[7][m], 6) for m in ("precision", "recall", "f1")] == [0.2149, 0.862069, 0.344037]
    assert [round(rows[14][m], 6) for m in ("precision", "recall", "f1")] == [0.875, 0.887324, 0.881119]
    assert rows[5]["precision"] == rows[5]["recall"] == rows[5]["f1"] == 0.0


def test_source_shares(spark):
    # Clips and windows of two sources of one class; the windows sit on one clip of each source.
    rows = [("A", 25695 if i == 0 else 0) for i in range(216)] + [("B", 3324 if i == 0 else 0) for i in range(69)]
    df = spark.createDataFrame([("Aircraft", s, w) for s, w in rows], "project_class string, source string, n_windows long")
    out = {r["source"]: r for r in diagnostics.class_source_confounding(df, "project_class", "source").collect()}
    assert (out["A"]["clip_share"], out["A"]["window_share"], out["A"]["flag_over_80"]) == (0.7578947368421053, 0.8854543574899204, True)
    assert (out["B"]["clip_share"], out["B"]["window_share"], out["B"]["flag_over_80"]) == (0.24210526315789474, 0.1145456425100796, False)


def test_proportions(spark):
    rows = [("Aircraft", s) for s, n in (("train", 234), ("val", 51), ("test", 53)) for _ in range(n)]
    out = gates.proportions(spark.createDataFrame(rows, "project_class string, split string"), "project_class").collect()
    assert {r["split"]: round(r["share"], 4) for r in out if r["project_class"] == "Aircraft"} == {"train": 0.6923, "val": 0.1509, "test": 0.1568}
    assert all(r["ok"] for r in out)


def test_silence_levels(spark):
    summary = spark.createDataFrame(
        [("train", 348412, 23799), ("val", 80554, 5724), ("test", 81370, 5882)], "split string, raw_windows long, dropped_silent long"
    )
    features = spark.createDataFrame([(s, [0.5] * 20) for s in ("train", "val", "test")], "split string, x array<double>")
    ledger = summary.select("split", F.lit(0.0).alias("pad_fraction"), F.lit(False).alias("truncated"))
    out = {(r["metric"], r["split"]): (round(r["value"], 4), r["level"]) for r in gates.artifact_levels(summary, features, "x", ledger).collect()}
    assert out["silence_drop_rate", "train"] == (0.0683, "ok")
    assert out["silence_drop_rate", "val"] == (0.0711, "ok")
    assert out["silence_drop_rate", "test"] == (0.0723, "ok")
    assert out["silence_drop_spread", "all"] == (0.004, "ok")


def test_balanced_weights(spark):
    counts = {0: 6, 1: 3, 2: 1}
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "class_id int")
    tax = spark.createDataFrame([(c, str(c)) for c in counts], "class_id int, class_name string")
    out = {r["class_id"]: r["weight"] for r in diagnostics.class_weights(df, "class_id", tax).collect()}
    assert sum(out[c] * n for c, n in counts.items()) == pytest.approx(10.0)
