"""Split queries: customers as source groups, order priority as class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..operators import splits as op
from ..params import PROPORTION_TOLERANCE
from .fixtures import CLIPS_SQL, clips
from .registry import query, table

SPLIT_CASE = "CASE WHEN ({c} + n_clips / 2.0::DOUBLE) / {t} < 0.7::DOUBLE THEN 'train' WHEN ({c} + n_clips / 2.0::DOUBLE) / {t} < 0.85::DOUBLE THEN 'val' ELSE 'test' END"
DOMINANT_SQL = f"""(SELECT group_key, CAST(sum(k) AS BIGINT) AS n_clips, arg_min(project_class, (-k, project_class)) AS stratum,
  CAST(sum(s) AS DOUBLE) / sum(k) AS group_mean
  FROM (SELECT group_key, project_class, count(*) AS k, sum(cents) AS s FROM {CLIPS_SQL} GROUP BY ALL) GROUP BY group_key)"""


def placed_sql(strata: str, source: str, seed: str) -> str:
    w = f"PARTITION BY {strata} ORDER BY md5({seed} || ':' || CAST(group_key AS VARCHAR)), group_key"
    return f"""(SELECT * EXCLUDE (c, t), {SPLIT_CASE.format(c='c', t='t')} AS split FROM (
      SELECT *, coalesce(CAST(sum(n_clips) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS c,
        CAST(sum(n_clips) OVER (PARTITION BY {strata}) AS BIGINT) AS t FROM {source}))"""


GROUPS_SQL = placed_sql("stratum", DOMINANT_SQL, "'42'")
BINNED_GROUPS_SQL = f"""(SELECT *, (rank * least(10, n)) // n AS bin FROM (SELECT *,
  row_number() OVER (PARTITION BY stratum ORDER BY group_mean, group_key) - 1 AS rank,
  count(*) OVER (PARTITION BY stratum) AS n FROM {DOMINANT_SQL}))"""
BALANCED_SQL = placed_sql("stratum, bin", BINNED_GROUPS_SQL, "'42'")
SPLIT_CLIPS_SQL = f"(SELECT c.*, g.split FROM {CLIPS_SQL} c JOIN {GROUPS_SQL} g USING (group_key))"
METRICS = ("cents", "days")
LONG_SQL = f"""(SELECT clip_id, project_class, split, 'cents' AS metric, cents::DOUBLE AS value FROM {SPLIT_CLIPS_SQL}
  UNION ALL SELECT clip_id, project_class, split, 'days', days::DOUBLE FROM {SPLIT_CLIPS_SQL})"""


def split_clips(spark, sf):
    rows = clips(spark, sf)
    return op.apply_split(rows, op.group_stratified_split(rows, "group_key", "project_class", 42), "group_key")


@query(
    "group_class_stats",
    f"""SELECT group_key, project_class, count(*) AS k, sum(days::DOUBLE) AS sum_days,
          sum(days::DOUBLE * days) AS sumsq_days FROM {CLIPS_SQL} GROUP BY ALL""",
)
def group_class_stats(spark, sf):
    return op.group_class_stats(clips(spark, sf), "group_key", "project_class", ["days"])


@query("group_stratified_split", f"SELECT group_key, n_clips, stratum, split FROM {GROUPS_SQL}")
def group_stratified_split(spark, sf):
    return op.group_stratified_split(clips(spark, sf), "group_key", "project_class", 42)


@query(
    "class_covariate_stats",
    f"""SELECT project_class, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std,
          stddev_pop(value) > 1e-6 AS active FROM {LONG_SQL} GROUP BY ALL""",
)
def class_covariate_stats(spark, sf):
    out = op.class_covariate_stats(clips(spark, sf), "project_class", METRICS)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


BIN_SQL = f"""(SELECT clip_id, project_class, metric, split, (rank * least(10, n)) // n AS bin FROM (SELECT *,
  row_number() OVER (PARTITION BY project_class, metric ORDER BY value, clip_id) - 1 AS rank,
  count(*) OVER (PARTITION BY project_class, metric) AS n FROM {LONG_SQL}))"""


def binned(spark, sf):
    long = op.unpivot(split_clips(spark, sf), ["clip_id", "project_class", "split"], METRICS)
    return op.quantile_rank_bin(long, ["project_class", "metric"], "value", ["clip_id"], "bin").drop("value")


@query("quantile_rank_bin", f"SELECT * FROM {BIN_SQL}")
def quantile_rank_bin(spark, sf):
    return binned(spark, sf)


HIST_SQL = f"""(SELECT project_class, metric, split, sum(g * g) AS gap FROM (
  SELECT s.project_class, s.metric, s.split, coalesce(k.k, 0) / s.n - b.k / t.n AS g FROM
    (SELECT project_class, metric, split, count(*)::DOUBLE AS n FROM {BIN_SQL} GROUP BY ALL) s
    JOIN (SELECT project_class, metric, bin, count(*)::DOUBLE AS k FROM {BIN_SQL} GROUP BY ALL) b USING (project_class, metric)
    JOIN (SELECT project_class, metric, count(*)::DOUBLE AS n FROM {BIN_SQL} GROUP BY ALL) t USING (project_class, metric)
    LEFT JOIN (SELECT project_class, metric, split, bin, count(*)::DOUBLE AS k FROM {BIN_SQL} GROUP BY ALL) k
      ON k.project_class = s.project_class AND k.metric = s.metric AND k.split = s.split AND k.bin = b.bin) GROUP BY ALL)"""


@query("bin_histogram_match", f"SELECT project_class, metric, split, round(gap, 9) AS gap FROM {HIST_SQL}")
def bin_histogram_match(spark, sf):
    out = op.bin_histogram_match(binned(spark, sf), ["project_class", "metric"])
    return out.withColumn("gap", F.round("gap", 9))


@query(
    "covariate_balanced_split",
    f"SELECT group_key, n_clips, stratum, group_mean, CAST(bin AS BIGINT) AS bin, split FROM {BALANCED_SQL}",
)
def covariate_balanced_split(spark, sf):
    return op.covariate_balanced_split(clips(spark, sf), "group_key", "project_class", "cents", 42)


SHARES_SQL = f"""(SELECT project_class, n, split, k, target, k / n::DOUBLE AS share, abs(k / n::DOUBLE - target) AS deviation FROM (
  SELECT project_class, count(*) AS n, unnest(['train','val','test']) AS split,
    unnest([0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE]) AS target,
    unnest([count(*) FILTER (WHERE split='train'), count(*) FILTER (WHERE split='val'), count(*) FILTER (WHERE split='test')]) AS k
  FROM {SPLIT_CLIPS_SQL} GROUP BY project_class))"""


@query(
    "imbalance_objective",
    f"""WITH ref AS (SELECT project_class, metric, avg(value) AS mu, stddev_pop(value) AS sd FROM {LONG_SQL} GROUP BY ALL),
        cell AS (SELECT project_class, metric, split, count(*) AS k, avg(value) AS m, stddev_pop(value) AS s FROM {LONG_SQL} GROUP BY ALL),
        t AS (SELECT c.project_class, c.split, sum(((m - mu) / sd) ** 2) AS mean_term,
                sum(CASE WHEN k >= 2 THEN (s / sd - 1) ** 2 ELSE 0 END) AS spread_term, sum(h.gap) AS histogram_term
              FROM cell c JOIN ref USING (project_class, metric) JOIN {HIST_SQL} h
                ON h.project_class = c.project_class AND h.metric = c.metric AND h.split = c.split GROUP BY ALL)
        SELECT s.project_class, s.split, round(((k - n * target) / greatest(n * target, 1)) ** 2, 9) AS count_term,
          round(mean_term, 9) AS mean_term, round(spread_term, 9) AS spread_term, round(histogram_term, 9) AS histogram_term,
          round(((k - n * target) / greatest(n * target, 1)) ** 2 + mean_term + 0.5::DOUBLE * spread_term + histogram_term, 9) AS objective
        FROM {SHARES_SQL} s JOIN t USING (project_class, split)""",
)
def imbalance_objective(spark, sf):
    out = op.imbalance_objective(split_clips(spark, sf), "project_class", METRICS, "clip_id")
    terms = ("count_term", "mean_term", "spread_term", "histogram_term", "objective")
    return out.withColumns({t: F.round(t, 9) for t in terms})


def ks_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {keys}, unnest(['val','test']) AS other, n_train AS n_ref, unnest([n_val, n_test]) AS n_other,
      unnest([d_val, d_test]) AS d FROM (
      SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, max(n_train) AS n_train, max(n_val) AS n_val, max(n_test) AS n_test,
        max(abs(ctr / nullif(n_train, 0)::DOUBLE - cv / nullif(n_val, 0)::DOUBLE)) AS d_val,
        max(abs(ctr / nullif(n_train, 0)::DOUBLE - ct / nullif(n_test, 0)::DOUBLE)) AS d_test FROM (
        SELECT {keys}, value, CAST(sum(count(*) FILTER (WHERE split='train')) OVER w AS BIGINT) AS ctr,
          CAST(sum(count(*) FILTER (WHERE split='val')) OVER w AS BIGINT) AS cv,
          CAST(sum(count(*) FILTER (WHERE split='test')) OVER w AS BIGINT) AS ct
        FROM {source} GROUP BY {keys}, value WINDOW w AS (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING)) c
      JOIN (SELECT {keys}, count(*) FILTER (WHERE split='train') AS n_train, count(*) FILTER (WHERE split='val') AS n_val,
              count(*) FILTER (WHERE split='test') AS n_test FROM {source} GROUP BY {keys}) t ON {on}
      GROUP BY {', '.join('c.' + k.strip() for k in keys.split(','))}))"""


def split_ks(spark, sf):
    long = op.unpivot(split_clips(spark, sf), ["project_class", "split"], METRICS)
    return op.ks_statistic(long, ["project_class", "metric"], "value")


@query("ks_statistic", f"SELECT project_class, metric, other, n_ref, n_other, round(d, 9) AS d FROM {ks_sql(LONG_SQL, 'project_class, metric')}")
def ks_statistic(spark, sf):
    return split_ks(spark, sf).withColumn("d", F.round("d", 9))


THRESHOLDS = {"cents": 0.05, "days": 0.04}
LIMIT_SQL = "(CASE metric WHEN 'cents' THEN 0.05::DOUBLE ELSE 0.04::DOUBLE END)"
ENERGY = f"""count(*) FILTER (WHERE d > {LIMIT_SQL}) AS crossings,
  round(sum(CASE WHEN d > {LIMIT_SQL} THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * (d / {LIMIT_SQL}) * (d / {LIMIT_SQL})), 9) AS energy"""


@query(
    "ks_crossings_energy",
    f"SELECT {ENERGY} FROM {ks_sql(LONG_SQL, 'project_class, metric')} WHERE least(n_ref, n_other) >= 15",
)
def ks_crossings_energy(spark, sf):
    return op.ks_crossings_energy(split_ks(spark, sf), THRESHOLDS).withColumn("energy", F.round("energy", 9))


SEEDED_GROUPS_SQL = f"(SELECT *, unnest([42, 1, 2, 3]) AS seed FROM {DOMINANT_SQL})"
SEEDED_SQL = placed_sql("seed, stratum", SEEDED_GROUPS_SQL, "CAST(seed AS VARCHAR)")
MEMBERS_SQL = f"(SELECT c.*, g.seed, g.split FROM {CLIPS_SQL} c JOIN {SEEDED_SQL} g USING (group_key))"
SEED_LONG_SQL = f"""(SELECT seed, project_class, split, 'cents' AS metric, cents::DOUBLE AS value FROM {MEMBERS_SQL}
  UNION ALL SELECT seed, project_class, split, 'days', days::DOUBLE FROM {MEMBERS_SQL})"""


@query(
    "best_seed_split",
    f"""WITH e AS (SELECT seed, {ENERGY} FROM {ks_sql(SEED_LONG_SQL, 'seed, project_class, metric')} WHERE least(n_ref, n_other) >= 15 GROUP BY seed),
        b AS (SELECT seed, count(*) FILTER (WHERE greatest(abs(tr - 0.7::DOUBLE), abs(va - 0.15::DOUBLE), abs(te - 0.15::DOUBLE)) > 0.05::DOUBLE) AS breaches
              FROM (SELECT seed, project_class, count(*) FILTER (WHERE split='train') / count(*)::DOUBLE AS tr,
                 count(*) FILTER (WHERE split='val') / count(*)::DOUBLE AS va, count(*) FILTER (WHERE split='test') / count(*)::DOUBLE AS te
                 FROM {MEMBERS_SQL} GROUP BY ALL) GROUP BY seed)
        SELECT s.seed, s.group_key, s.n_clips, s.stratum, s.split FROM {SEEDED_SQL} s
        WHERE s.seed = (SELECT seed FROM b LEFT JOIN e USING (seed) ORDER BY breaches, coalesce(crossings, 0), coalesce(energy, 0), seed LIMIT 1)""",
)
def best_seed_split(spark, sf):
    _, best = op.best_seed_split(clips(spark, sf), "group_key", "project_class", THRESHOLDS, (42, 1, 2, 3))
    return best


@query(
    "group_split_table",
    f"""SELECT group_key, split, count(*) AS n_clips, array_to_string(list_sort(list_distinct(list(project_class))), ';') AS classes
        FROM {SPLIT_CLIPS_SQL} GROUP BY group_key, split""",
)
def group_split_table(spark, sf):
    out = op.group_split_table(split_clips(spark, sf), "group_key", "project_class")
    return out.withColumn("classes", F.array_join("classes", ";"))


@query("max_proportion_deviation", f"SELECT round(max(deviation), 9) AS max_deviation FROM {SHARES_SQL}")
def max_proportion_deviation(spark, sf):
    return op.max_proportion_deviation(split_clips(spark, sf), "project_class").select(
        F.round("max_deviation", 9).alias("max_deviation")
    )


def brand_parts(spark, sf):
    """Parts as clips of few large groups: 25 brands, six classes."""
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("group_key"), F.col("p_type").alias("project_class"))


@query(
    "split_repair",
    """SELECT p_type AS project_class, s.split, count(*) AS n, s.target, TRUE AS inside FROM part,
       (VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) AS s(split, target) GROUP BY ALL""",
)
def split_repair(spark, sf):
    """Classes of a split that is repaired until each share is inside the band; the twin says that all are."""
    rows = brand_parts(spark, sf)
    placed = op.group_stratified_split(rows, "group_key", "project_class", 42)
    fixed = op.apply_split(rows, repair.repair_split(rows, placed, "group_key", "project_class"), "group_key")
    shares = op.class_split_shares(fixed, "project_class")
    return shares.select("project_class", "split", "n", "target", (F.col("deviation") <= PROPORTION_TOLERANCE).alias("inside"))
