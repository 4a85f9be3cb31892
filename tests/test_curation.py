"""Curation rules on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.functions.columns import label_set
from auricle.operators import checks
from auricle.operators import curation as op
from auricle.operators import health, ledger


def test_items_cut_by_a_cap_stay_available(spark):
    df = spark.createDataFrame([(i, "a,b" if i < 10 else "b") for i in range(14)], "id long, labels string")
    rules = [
        op.Rule("A", op.match_any(label_set("labels"), ["a"]), cap=4),
        op.Rule("B", op.match_any(label_set("labels"), ["b"]), cap=6),
        op.Rule("Rest", op.match_any(label_set("labels"), ["a"])),
    ]
    out = op.priority_assign(df, "id", rules, seed=1).collect()
    by = {}
    for r in out:
        by.setdefault(r["project_class"], set()).add(r["id"])
    assert len(by["A"]) == 4 and len(by["B"]) == 6
    assert by["Rest"] == set(range(10)) - by["A"] - by["B"]
    again = op.priority_assign(df.repartition(3), "id", rules, seed=1).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


@pytest.mark.parametrize("seed", range(4))
def test_many_capped_rules_equal_a_loop(spark, seed):
    """Rules with and without caps over random labels, against taking them one after the other."""
    import hashlib
    import random

    r = random.Random(seed)
    rows = [(i, ",".join(x for x in "abcde" if r.random() < 0.4)) for i in range(120)]
    plan = [(f"R{k}", "abcde"[r.randrange(5)], r.choice([None, 1, 3, 8, 500])) for k in range(7)]
    df = spark.createDataFrame(rows, "id long, labels string")
    rules = [op.Rule(n, op.match_any(label_set("labels"), [x]), cap=c) for n, x, c in plan]
    left = sorted(rows, key=lambda t: (hashlib.md5(f"5:{t[0]}".encode()).hexdigest(), t[0]))
    want = {}
    for n, x, cap in plan:
        hits = [t for t in left if x in t[1].split(",")][:cap]
        want.update({t[0]: n for t in hits})
        left = [t for t in left if t not in hits]
    got = op.priority_assign(df, "id", rules, seed=5).collect()
    assert {t["id"]: t["project_class"] for t in got} == want and len(got) == len(want)


def test_cap_above_the_hits_takes_all(spark):
    df = spark.createDataFrame([(i, "a") for i in range(3)], "id long, labels string")
    out = op.priority_assign(df, "id", [op.Rule("A", op.match_any(label_set("labels"), ["a"]), cap=5)], seed=1)
    assert out.count() == 3


def test_guard_ignores_null_ids(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "sid string")
    used = [spark.createDataFrame([("a",), (None,)], "x string"), spark.createDataFrame([("c",)], "y string")]
    assert [r[0] for r in op.leakage_guard(df, "sid", used).collect()] == ["b"]


def test_fallback_switches_on_the_count(spark):
    df = spark.createDataFrame([(1, "glass,shatter"), (2, "shatter"), (3, "glass")], "id int, labels string")
    for minimum, want in ((1, [1]), (2, [1, 2])):
        out = op.match_all_or_fallback(df, label_set("labels"), ["glass", "shatter"], "shatter", minimum)
        assert sorted(r["id"] for r in out.collect()) == want


def test_incremental_merge_keeps_old(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, op.incremental_merge(old, new, ["k"], ["v"]).collect())) == [("a", 1), ("b", 3)]


def test_one_to_one_join_refuses(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(checks.DataContractError, match="right_duplicates=1"):
        checks.one_to_one_join(a, spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])
    with pytest.raises(checks.DataContractError, match="missing_right=1"):
        checks.one_to_one_join(a, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert checks.one_to_one_join(a, a, ["k"]).count() == 2


def test_missing_manifest_column(spark):
    df = spark.createDataFrame([("x",)], "source_file string")
    with pytest.raises(ValueError, match="local_path"):
        op.union_manifests([df], {}, ["source_file", "local_path"], [])


def test_hash_match_has_three_values(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(health.hash_match("x", "y")).collect()] == [True, False, None, None]


def test_group_key_rejects_malformed_ids(spark):
    uuid = "0123ABCD-0000-1111-2222-333344445555"
    df = spark.createDataFrame(
        [("S", f"donateacry:{uuid}-9"), ("S", "donateacry:xx"), ("S", "recanvo:200101_0930_x"), ("S", "recanvo:1"), ("FSD", "7"), ("S", ""), ("S", "nan")],
        "d string, sid string",
    )
    got = [r[0] for r in df.select(ledger.group_key("d", "sid")).collect()]
    assert got == [f"babycry/donateacry:{uuid.lower()}", None, "babycry/recanvo:200101_0930", None, "fsd/7", None, None]


def test_ledger_raises(spark):
    tax = spark.createDataFrame([(0, "A")], "class_id int, class_name string")
    df = spark.createDataFrame([("B",)], "project_class string")
    with pytest.raises(checks.DataContractError, match="B"):
        ledger.class_id_lookup(df, tax, "project_class")
    with pytest.raises(checks.DataContractError, match="not unique"):
        ledger.check_unique(spark.createDataFrame([("x",), ("x",)], "clip_id string"), "clip_id")


def test_duplicate_groups_of_a_hot_hash(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sha"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("source"),
        F.lit("c").alias("cls"),
        "id",
    )
    groups = health.duplicate_content_groups(df, "sha", "source", "cls")
    row = groups.collect()[0]
    assert (row["sha"], row["n"], row["sources"], row["classes"]) == ("hot", 334, ["s0", "s1"], ["c"])
    assert health.duplicate_members(df, groups, "sha").count() == 334


def test_signal_diagnostics(spark):
    import numpy as np

    n, rate, hop = 64, 640, 16
    tone = np.sin(2 * np.pi * 100 * np.arange(n) / rate + 0.1)
    x = np.concatenate([np.zeros(hop), tone[hop:]]) + 0.0
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * n), (3, [])], "id int, s array<double>")
    out = {r["id"]: r for r in health.signal_diagnostics(df, "id", "s", rate, hop).collect()}
    r = out[1]
    k, i = np.arange(n // 2 + 1)[:, None], np.arange(n)
    spectrum = np.abs((np.exp(-2j * np.pi * k * i / n) * (x * np.hanning(n))).sum(axis=1))
    centroid = (k[:, 0] * rate / n * spectrum).sum() / spectrum.sum()
    crossings = [np.abs(np.diff(np.sign(f))).mean() / 2 for f in x.reshape(-1, hop)]
    assert r["dc_offset"] == pytest.approx(x.mean()) and r["silence_ratio"] == 0.25
    assert r["spectral_centroid_hz"] == pytest.approx(centroid) and r["zcr"] == pytest.approx(np.mean(crossings))
    assert r["crest_factor"] == pytest.approx(np.abs(x).max() / np.sqrt((x * x).mean()))
    assert out[2]["silence_ratio"] == 1.0 and out[2]["crest_factor"] is None
    assert out[3]["silence_ratio"] == 1.0 and out[3]["zcr"] == 0.0


def test_signal_diagnostics_of_odd_signals(spark):
    rng = np.random.default_rng(3)
    signals = {1: [], 2: None, 3: [0.0] * 32, 4: [1.0, -1.0] * 16, 5: [0.5] * 3, 6: rng.normal(size=40).tolist()}
    df = spark.createDataFrame(list(signals.items()), "id int, s array<double>")
    got = {r.id: r for r in health.signal_diagnostics(df, "id", "s", 100, 16).collect()}
    assert len(got) == 6 and [got[2][c] for c in ("dc_offset", "silence_ratio", "zcr", "spectral_centroid_hz", "crest_factor")] == [None] * 5
    assert (got[1].dc_offset, got[1].silence_ratio, got[1].zcr, got[1].crest_factor) == (0.0, 1.0, 0.0, None)
    assert (got[3].silence_ratio, got[3].crest_factor, got[3].spectral_centroid_hz) == (1.0, None, 0.0)
    assert (got[4].zcr, got[4].silence_ratio, got[4].crest_factor) == (1.0, 0.0, 1.0)
    assert (got[5].silence_ratio, got[5].zcr, got[5].dc_offset) == (1.0, 0.0, 0.5)
    x = np.array(signals[6])
    weights = np.abs(np.fft.rfft(x * np.hanning(40)))
    assert got[6].spectral_centroid_hz == pytest.approx((weights * np.fft.rfftfreq(40, 0.01)).sum() / weights.sum())
    assert got[6].crest_factor == pytest.approx(np.abs(x).max() / np.sqrt((x * x).mean()))
