"""Gate queries over the customer-grouped split of orders, document hashes and signal features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import gates as op
from ..operators import splits as split_op
from ..operators import windows as win
from ..sources import sinks
from .fixtures import CLIPS_SQL, DOCUMENTS_SQL, clips, documents, hash_split, hash_split_sql, signals
from ..session import cut_lineage
from .registry import query
from .splits import GROUPS_SQL, LONG_SQL, SPLIT_CLIPS_SQL, ks_sql, split_clips
from .windows import BOUNDS_SQL, FLOOR_DB, FRAMES_SQL, LEVEL_SQL, SPLIT_SIGNALS_SQL, frames, split_signals

W = 16


def faulty_splits(spark, sf):
    """The split table with some rows lost, some doubled and some of unknown clips."""
    clip, group = F.col("clip_id"), F.col("group_key")

    def row(clip_id, group_key, split):
        return F.struct(clip_id.alias("clip_id"), group_key.alias("group_key"), split.alias("split"))

    variants = F.array_compact(
        F.array(
            F.when(clip % 50 != 7, row(clip, group, F.col("split"))),
            F.when(clip % 60 == 11, row(clip, group, F.lit("test"))),
            F.when(clip % 70 == 13, row(clip + 100000000, group + 100000000, F.col("split"))),
        )
    )
    return split_clips(spark, sf).select(F.explode(variants).alias("v")).select("v.*")


FAULTY_SQL = f"""(SELECT clip_id, group_key, split FROM {SPLIT_CLIPS_SQL} WHERE clip_id % 50 <> 7
  UNION ALL SELECT clip_id, group_key, 'test' FROM {SPLIT_CLIPS_SQL} WHERE clip_id % 60 = 11
  UNION ALL SELECT clip_id + 100000000, group_key + 100000000, split FROM {SPLIT_CLIPS_SQL} WHERE clip_id % 70 = 13)"""


@query(
    "gate_membership",
    f"""WITH s AS (SELECT clip_id, count(*) AS n FROM {FAULTY_SQL} GROUP BY clip_id),
        k AS (SELECT clip_id FROM {CLIPS_SQL} WHERE cents >= 5000000),
        p AS (SELECT 'duplicate' AS problem, clip_id, n - 1 AS w FROM s WHERE n > 1
              UNION ALL SELECT 'missing', clip_id, 1 FROM k WHERE clip_id NOT IN (SELECT clip_id FROM s)
              UNION ALL SELECT 'extra', clip_id, 1 FROM s WHERE clip_id NOT IN (SELECT clip_id FROM k))
        SELECT problem, CAST(sum(w) AS BIGINT) AS n, array_to_string((list(clip_id ORDER BY clip_id))[1:3], ',') AS examples
        FROM p GROUP BY problem""",
)
def gate_membership(spark, sf):
    kept = clips(spark, sf).filter("cents >= 5000000")
    out = op.membership(kept, faulty_splits(spark, sf), "clip_id")
    return out.withColumn("examples", F.array_join("examples", ","))


@query(
    "gate_group_atomicity",
    f"""WITH c AS (SELECT group_key, list_sort(list_distinct(list(split))) AS s FROM {FAULTY_SQL} GROUP BY group_key),
        g AS (SELECT group_key, CASE WHEN group_key % 9 = 4 THEN 'val' ELSE split END AS split FROM {GROUPS_SQL} WHERE group_key % 11 <> 5)
        SELECT * FROM (SELECT coalesce(c.group_key, g.group_key) AS group_key, CASE WHEN c.s IS NULL THEN 'unknown_to_clips' WHEN g.split IS NULL
            THEN 'missing_from_groups' WHEN len(c.s) > 1 THEN 'several_splits' WHEN c.s[1] <> g.split THEN 'tables_disagree' END AS problem,
            coalesce(array_to_string(c.s, ','), '') AS clip_splits, g.split AS group_split
          FROM c FULL OUTER JOIN g ON c.group_key = g.group_key) WHERE problem IS NOT NULL""",
)
def gate_group_atomicity(spark, sf):
    groups = split_op.group_stratified_split(clips(spark, sf), "group_key", "project_class", 42)
    groups = groups.filter("group_key % 11 <> 5").withColumn(
        "split", F.when(F.col("group_key") % 9 == 4, "val").otherwise(F.col("split"))
    )
    return op.group_atomicity(faulty_splits(spark, sf), groups, "group_key")


@query(
    "gate_hash_disjoint",
    f"""SELECT sha256, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits
        FROM (SELECT sha256, {hash_split_sql('doc_id')} AS split FROM {DOCUMENTS_SQL}) GROUP BY sha256 HAVING count(DISTINCT split) > 1""",
)
def gate_hash_disjoint(spark, sf):
    rows = documents(spark, sf).withColumn("split", hash_split("doc_id"))
    return op.hash_disjoint(rows, "sha256").withColumn("splits", F.array_join("splits", ","))


PROPORTIONS_SQL = f"""(SELECT project_class, n_clips, split, target, k / n_clips::DOUBLE AS share, abs(k / n_clips::DOUBLE - target) AS deviation,
  abs(k / n_clips::DOUBLE - target) <= 0.05::DOUBLE AS ok FROM (
  SELECT coalesce(project_class, 'ALL') AS project_class, count(*) AS n_clips, unnest(['train','val','test']) AS split,
    unnest([0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE]) AS target,
    unnest([count(*) FILTER (WHERE split='train'), count(*) FILTER (WHERE split='val'), count(*) FILTER (WHERE split='test')]) AS k
  FROM {SPLIT_CLIPS_SQL} GROUP BY GROUPING SETS ((project_class), ())))"""


@query(
    "gate_proportions",
    f"SELECT project_class, n_clips, split, target, round(share, 6) AS share, round(deviation, 6) AS deviation, ok FROM {PROPORTIONS_SQL}",
)
def gate_proportions(spark, sf):
    out = op.proportions(split_clips(spark, sf), "project_class")
    return out.withColumns({"share": F.round("share", 6), "deviation": F.round("deviation", 6)})


def scaled_features(spark, sf):
    rows = split_signals(spark, sf)
    return win.scale_clip01(rows, "samples", win.frozen_bounds(rows, "samples"))


SCALED_SQL = f"""(SELECT clip_id, class_id, split, list_transform(samples, lambda x: least(greatest((x::DOUBLE - lo) / (hi - lo), 0), 1)) AS samples
  FROM {SPLIT_SIGNALS_SQL}, {BOUNDS_SQL})"""
BROKEN_SQL = f"""(SELECT split, class_id + CASE WHEN clip_id % 41 = 3 THEN 10 ELSE 0 END AS class_id,
  CASE WHEN clip_id % 37 = 5 THEN list_append(samples, 0.5::DOUBLE) WHEN clip_id % 43 = 7 THEN list_append(samples[1:63], 'nan'::DOUBLE)
       WHEN clip_id % 47 = 9 THEN list_append(samples[1:63], 1.5::DOUBLE) ELSE samples END AS samples FROM {SCALED_SQL})"""


@query(
    "gate_artifacts",
    f"""SELECT split, count(*) AS windows, count(*) FILTER (WHERE len(samples) <> 64) AS wrong_shape,
          count(*) FILTER (WHERE len(list_filter(samples, lambda x: isnan(x) OR isinf(x))) > 0) AS non_finite,
          count(*) FILTER (WHERE list_min(samples) < 0) AS below_zero, count(*) FILTER (WHERE list_max(samples) > 1) AS above_one,
          count(*) FILTER (WHERE class_id NOT BETWEEN 0 AND 9) AS bad_label, count(*) AS expected_windows, count(*) = 0 AS ok
        FROM {BROKEN_SQL} GROUP BY split""",
)
def gate_artifacts(spark, sf):
    rows = scaled_features(spark, sf)
    head = F.slice("samples", 1, 63)
    broken = rows.select(
        "split",
        (F.col("class_id") + F.when(F.col("clip_id") % 41 == 3, 10).otherwise(0)).alias("class_id"),
        F.when(F.col("clip_id") % 37 == 5, F.array_append("samples", F.lit(0.5)))
        .when(F.col("clip_id") % 43 == 7, F.array_append(head, F.lit(float("nan"))))
        .when(F.col("clip_id") % 47 == 9, F.array_append(head, F.lit(1.5)))
        .otherwise(F.col("samples"))
        .alias("samples"),
    )
    expected = rows.groupBy("split").agg(F.count(F.lit(1)).alias("windows"))
    return op.artifacts(broken, "samples", "class_id", 64, 10, expected)


@query(
    "gate_distribution_stats",
    f"""SELECT project_class, split, metric, count(*) AS n_clips, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS std,
          quantile_cont(value, 0.5) AS median FROM {LONG_SQL} GROUP BY ALL""",
)
def gate_distribution_stats(spark, sf):
    out = op.distribution_stats(split_clips(spark, sf), "project_class", ["cents", "days"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


KS_LIMITS = {"cents": (0.05, 0.10), "days": (0.04, 0.08)}
P_SQL = """CASE WHEN sqrt(n_ref * n_other / (n_ref + n_other)::DOUBLE) * d < 0.05 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * (n_ref * n_other / (n_ref + n_other)::DOUBLE) * d * d))), 0), 1) END"""
GATE_KS_SQL = f"""(SELECT project_class, metric, 'train vs ' || other AS comparison,
  CASE WHEN least(n_ref, n_other) >= 2 THEN d END AS ks_d, CASE WHEN least(n_ref, n_other) >= 2 THEN {P_SQL} END AS p_value,
  CASE WHEN least(n_ref, n_other) < 2 THEN 'insufficient_n' WHEN least(n_ref, n_other) < 15 THEN 'underpowered_n'
       WHEN d > CASE metric WHEN 'cents' THEN 0.10::DOUBLE ELSE 0.08::DOUBLE END THEN 'severe'
       WHEN d > CASE metric WHEN 'cents' THEN 0.05::DOUBLE ELSE 0.04::DOUBLE END THEN 'flag' ELSE 'ok' END AS level
  FROM {ks_sql(LONG_SQL, 'project_class, metric')})"""


# The exact p-value: lattice paths that leave the band, one diagonal a step; the series beyond the switch.
EXACT_KS_SQL = f"""(WITH RECURSIVE base AS MATERIALIZED (SELECT *, 'train vs ' || other AS comparison, least(n_ref, n_other) AS n, greatest(n_ref, n_other) AS m,
    CAST(round(d * n_ref * n_other) AS BIGINT) AS far FROM {ks_sql(LONG_SQL, 'project_class, metric')}),
  walk AS (SELECT project_class, metric, comparison, n, m, far, CAST(0 AS BIGINT) AS k, list_transform(range(0, n + 1), lambda i: 0.0::DOUBLE) AS q
      FROM base WHERE n >= 2 AND m <= 10000
    UNION ALL SELECT project_class, metric, comparison, n, m, far, k + 1, list_transform(range(0, n + 1), lambda i:
        CASE WHEN i > k + 1 OR k + 1 - i > m THEN 0 WHEN abs(i * m - (k + 1 - i) * n) >= far THEN 1
             ELSE (i * coalesce(q[i], 0) + (k + 1 - i) * q[i + 1]) / (k + 1) END) FROM walk WHERE k < n + m)
  SELECT project_class, metric, comparison, q[n + 1] AS exact_p FROM walk WHERE k = n + m)"""


@query(
    "gate_distribution_ks",
    f"""SELECT project_class, metric, comparison, round(ks_d, 9) AS ks_d, round(coalesce(exact_p, p_value), 9) AS p_value, level
        FROM {GATE_KS_SQL} LEFT JOIN {EXACT_KS_SQL} USING (project_class, metric, comparison)""",
)
def gate_distribution_ks(spark, sf):
    out = op.distribution_ks(split_clips(spark, sf), "project_class", KS_LIMITS)
    return out.withColumns({"ks_d": F.round("ks_d", 9), "p_value": F.round("p_value", 9)})


POOLED_SQL = f"""(SELECT split, count(*) AS windows, avg(m) AS feature_mean, stddev_pop(m) AS feature_std FROM (
  SELECT split, list_sum(samples) / 64 AS m FROM {SCALED_SQL}) GROUP BY split)"""


@query(
    "gate_pooled_delta",
    f"""SELECT split, windows, round(feature_mean, 8) AS feature_mean, round(feature_std, 8) AS feature_std, round(delta, 8) + 0.0 AS delta_vs_train,
          CASE WHEN abs(delta) > 0.08 THEN 'severe' WHEN abs(delta) > 0.03 THEN 'flag' ELSE 'ok' END AS level
        FROM (SELECT *, CASE WHEN split = 'train' THEN 0.0::DOUBLE ELSE feature_mean - (SELECT feature_mean FROM {POOLED_SQL} WHERE split = 'train') END
              AS delta FROM {POOLED_SQL})""",
)
def gate_pooled_delta(spark, sf):
    rows = scaled_features(spark, sf).select("split", v.mean("samples").alias("m"))
    out = op.pooled_delta(rows, "m")
    return out.withColumns({c: F.round(c, 8) for c in ("feature_mean", "feature_std", "delta_vs_train")})


@query(
    "gate_leakage_restate",
    f"""SELECT gate, problems FROM (
          SELECT 'G3' AS gate, (SELECT count(*) FROM (SELECT sha256 FROM (SELECT sha256, {hash_split_sql('doc_id')} AS split FROM {DOCUMENTS_SQL})
             GROUP BY sha256 HAVING count(DISTINCT split) > 1)) AS problems
          UNION ALL SELECT 'G4', (SELECT count(*) FROM {PROPORTIONS_SQL} WHERE NOT ok)) WHERE problems <> 0""",
)
def gate_leakage_restate(spark, sf):
    path = sinks.scratch_path(spark, "gates")
    hashes = op.hash_disjoint(documents(spark, sf).withColumn("split", hash_split("doc_id")), "sha256")
    shares = op.proportions(split_clips(spark, sf), "project_class").filter("NOT ok")
    stored = hashes.agg(F.count(F.lit(1)).alias("problems")).select(F.lit("G3").alias("gate"), "problems").unionByName(
        shares.agg(F.count(F.lit(1)).alias("problems")).select(F.lit("G4").alias("gate"), "problems")
    )
    sinks.write_table(stored, path, ["gate", "problems"])
    return op.leakage_restate(spark.read.parquet(path))


@query(
    "class_mean_examples",
    f"""WITH f AS (SELECT clip_id, class_id, start_sample, frame, {hash_split_sql('clip_id')} AS split FROM {FRAMES_SQL}),
        e AS (SELECT class_id, split, pos, avg(x) AS mean FROM (
                SELECT class_id, split, unnest(range({W})) AS pos, unnest(frame)::DOUBLE AS x FROM f) GROUP BY ALL),
        c AS (SELECT class_id, split, clip_id, arg_min(start_sample, md5('42:' || clip_id || ':' || start_sample)) AS start_sample FROM f GROUP BY ALL)
        SELECT 'mean' AS kind, class_id, split, CAST(pos AS BIGINT) AS k, round(mean, 8) + 0.0 AS x FROM e
        UNION ALL SELECT 'example', class_id, split, clip_id, start_sample FROM c
        QUALIFY row_number() OVER (PARTITION BY class_id, split ORDER BY md5('42:' || clip_id), clip_id) <= 3""",
)
def class_mean_examples(spark, sf):
    rows = frames(spark, sf).withColumn("split", hash_split("clip_id"))
    means = op.class_mean_arrays(rows, "frame", "class_id")
    shown = op.class_examples(rows, "class_id", "clip_id", "start_sample", seed=42)
    return means.select(
        F.lit("mean").alias("kind"), "class_id", "split", F.col("pos").cast("bigint").alias("k"), F.round("mean", 8).alias("x")
    ).unionByName(
        shown.select(
            F.lit("example").alias("kind"), "class_id", "split", F.col("clip_id").alias("k"), F.col("start_sample").cast("double").alias("x")
        )
    )


LEDGER_ROWS_SQL = f"""(SELECT split, 0.0::DOUBLE AS pad_fraction, cents > 40000000 AS truncated FROM {SPLIT_CLIPS_SQL} WHERE cents >= 5000000)"""
ARTIFACT_SQL = f"""(WITH w AS (SELECT split, count(*) AS raw, count(*) FILTER (WHERE {LEVEL_SQL} <= {FLOOR_DB}) AS dropped
    FROM (SELECT *, {hash_split_sql('clip_id')} AS split FROM {FRAMES_SQL}) GROUP BY split),
  d AS (SELECT split, dropped / raw::DOUBLE AS value FROM w),
  s AS (SELECT max(value) - min(value) AS value FROM d),
  f AS (SELECT split, CAST(sum(len(list_filter(samples, lambda x: x <= 0))) AS DOUBLE) / sum(len(samples)) AS fl,
          CAST(sum(len(list_filter(samples, lambda x: x >= 0.999999::DOUBLE))) AS DOUBLE) / sum(len(samples)) AS ce FROM {SCALED_SQL} GROUP BY split),
  t AS (SELECT split, count(*) FILTER (WHERE truncated) / count(*)::DOUBLE AS value FROM {LEDGER_ROWS_SQL} GROUP BY split)
  SELECT 'silence_drop_rate' AS metric, split, value, 'ok' AS level FROM d
  UNION ALL SELECT 'silence_drop_spread', 'all', value, CASE WHEN value > 0.05 THEN 'severe' WHEN value > 0.02 THEN 'flag' ELSE 'ok' END FROM s
  UNION ALL SELECT 'floor_value_fraction', split, fl, CASE WHEN fl > 0.20 THEN 'severe' WHEN fl > 0.05 THEN 'flag' ELSE 'ok' END FROM f
  UNION ALL SELECT 'ceiling_value_fraction', split, ce, CASE WHEN ce > 0.05 THEN 'severe' WHEN ce > 0.01 THEN 'flag' ELSE 'ok' END FROM f
  UNION ALL SELECT 'pad_fraction_max', 'all', max(pad_fraction), 'ok' FROM {LEDGER_ROWS_SQL}
  UNION ALL SELECT 'truncation_rate', split, value, 'ok' FROM t
  UNION ALL SELECT 'truncation_spread', 'all', max(value) - min(value), 'ok' FROM t)"""


def artifact_rows(spark, sf, rows=None):
    counts = win.window_counts(
        frames(spark, sf).withColumn("split", hash_split("clip_id")), "frame", ["split"], FLOOR_DB
    )
    ledger = (rows or split_clips(spark, sf)).filter("cents >= 5000000").select(
        "split", F.lit(0.0).alias("pad_fraction"), (F.col("cents") > 40000000).alias("truncated")
    )
    return op.artifact_levels(counts, scaled_features(spark, sf), "samples", ledger)


@query("gate_artifact_levels", f"SELECT metric, split, round(value, 9) AS value, level FROM {ARTIFACT_SQL}")
def gate_artifact_levels(spark, sf):
    return artifact_rows(spark, sf).withColumn("value", F.round("value", 9))


@query(
    "gate_verdict",
    f"""SELECT count(*) FILTER (WHERE level IN ('severe','fail')) AS severe, count(*) FILTER (WHERE level = 'flag') AS flags,
          count(*) FILTER (WHERE level = 'underpowered_n') AS underpowered, count(*) AS checks,
          CASE WHEN count(*) FILTER (WHERE level IN ('severe','fail')) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE level = 'flag') > 0
               THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS verdict
        FROM (SELECT level FROM {GATE_KS_SQL} UNION ALL SELECT level FROM {ARTIFACT_SQL}
              UNION ALL SELECT CASE WHEN ok THEN 'ok' ELSE 'fail' END FROM {PROPORTIONS_SQL})""",
)
def gate_verdict(spark, sf):
    rows = cut_lineage(split_clips(spark, sf))  # the split is made once, all parts read it
    parts = [
        op.distribution_ks(rows, "project_class", KS_LIMITS).select("level"),
        artifact_rows(spark, sf, rows).select("level"),
        op.proportions(rows, "project_class").select(F.when(F.col("ok"), "ok").otherwise("fail").alias("level")),
    ]
    return op.verdict(reduce(DataFrame.unionByName, parts))
