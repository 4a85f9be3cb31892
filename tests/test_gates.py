"""Splits and gates on small tables: empty, one row, ties, underpowered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import checks, gates
from auricle.operators import splits as op


def clip_table(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("clip_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("group_key"),
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("project_class"),
        (F.col("id") * 7919 % 1009).cast("double").alias("x"),
    )


def test_groups_are_atomic_and_all_clips_are_placed(spark):
    clips = clip_table(spark)
    for groups in (
        op.group_stratified_split(clips, "group_key", "project_class", 42),
        op.covariate_balanced_split(clips, "group_key", "project_class", "x", 42),
    ):
        placed = op.apply_split(clips, groups, "group_key")
        assert placed.count() == clips.count()
        assert gates.group_atomicity(placed, groups, "group_key").isEmpty()
        assert groups.count() == clips.select("group_key").distinct().count()


def test_small_groups_meet_the_proportions(spark):
    clips = clip_table(spark, 4000).withColumn("group_key", F.col("clip_id") % 1500)
    placed = op.apply_split(clips, op.group_stratified_split(clips, "group_key", "project_class", 42), "group_key")
    assert op.max_proportion_deviation(placed, "project_class", limit=0.05).first()[0] < 0.05
    with pytest.raises(checks.DataContractError):
        op.max_proportion_deviation(placed.withColumn("split", F.lit("train")), "project_class", limit=0.05)


def test_split_does_not_depend_on_partitioning(spark):
    clips = clip_table(spark)
    a = op.group_stratified_split(clips, "group_key", "project_class", 7).select("group_key", "split").collect()
    b = op.group_stratified_split(clips.repartition(7), "group_key", "project_class", 7).select("group_key", "split").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_ks_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 30, 200), rng.integers(5, 40, 60)
    rows = [("k", "train", float(x)) for x in a] + [("k", "val", float(x)) for x in b]
    df = spark.createDataFrame(rows, "k string, split string, v double")
    got = {r["other"]: r for r in op.ks_statistic(df, ["k"], "v").collect()}
    u = np.arange(-1, 41)
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in u)
    assert got["val"]["d"] == pytest.approx(want) and (got["val"]["n_ref"], got["val"]["n_other"]) == (200, 60)
    assert got["test"]["d"] is None and got["test"]["n_other"] == 0


def test_ks_levels(spark):
    rows = [("a", "train", float(i)) for i in range(40)] + [("a", "val", float(i)) for i in range(14)]
    rows += [("a", "test", 1.0)] + [("b", s, float(i)) for s in ("train", "val", "test") for i in range(40)]
    df = spark.createDataFrame(rows, "project_class string, split string, x double")
    out = {(r["project_class"], r["comparison"]): r for r in gates.distribution_ks(df, "project_class", {"x": (0.2, 0.4)}).collect()}
    assert out["a", "train vs val"]["level"] == "underpowered_n"
    assert out["a", "train vs test"]["level"] == "insufficient_n" and out["a", "train vs test"]["ks_d"] is None
    assert out["b", "train vs val"]["level"] == "ok" and out["b", "train vs val"]["p_value"] == 1.0


def test_membership_and_verdict(spark):
    kept = spark.createDataFrame([(1,), (2,), (3,)], "clip_id int")
    clean = kept.withColumn("split", F.lit("train"))
    assert gates.membership(kept, clean, "clip_id").isEmpty()
    bad = spark.createDataFrame([(1,), (1,), (1,), (9,)], "clip_id int")
    out = {r["problem"]: (r["n"], r["examples"]) for r in gates.membership(kept, bad, "clip_id").collect()}
    assert out == {"duplicate": (2, [1]), "missing": (2, [2, 3]), "extra": (1, [9])}

    def verdict(*levels):
        df = spark.createDataFrame([(x,) for x in levels], "level string")
        return gates.verdict(df).first()["verdict"]

    assert verdict("ok", "underpowered_n") == "PASS"
    assert verdict("ok", "flag") == "PASS WITH WARNINGS"
    assert verdict("flag", "severe") == "FAIL"


def test_gates_on_empty_tables(spark):
    empty = spark.createDataFrame([], "clip_id int, group_key int, split string, sha string, project_class string")
    assert gates.membership(empty, empty, "clip_id").isEmpty()
    assert gates.hash_disjoint(empty, "sha").isEmpty()
    assert gates.group_atomicity(empty, empty, "group_key").isEmpty()


def test_hot_hash_in_two_splits(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sha"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
    )
    assert [tuple(r) for r in gates.hash_disjoint(df, "sha").collect()] == [("hot", ["test", "train"])]


def test_best_seed_is_one_of_the_scored(spark):
    clips = clip_table(spark, 2000).withColumn("group_key", F.col("clip_id") % 700)
    scores, best = op.best_seed_split(clips, "group_key", "project_class", {"x": 0.05}, (1, 2, 3))
    rows = scores.collect()
    want = min((r["breaches"], r["crossings"], round(r["energy"], 9), r["seed"]) for r in rows)[3]
    assert {r[0] for r in best.select("seed").distinct().collect()} == {want} and len(rows) == 3
