"""Diagnostic queries: orders x lineitem for shares, embeddings for centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as op
from .fixtures import CLIPS_SQL, ORDER_CLASSES, clips, hash_split, hash_split_sql, taxonomy, taxonomy_sql
from .gates import BROKEN_SQL, SCALED_SQL, scaled_features
from .registry import query, table

DIGITS = [f"c{i}" for i in range(10)]


def split_classes_sql() -> str:
    return f"(SELECT class_id, class_name, unnest(['train','val','test']) AS split FROM {taxonomy_sql([*DIGITS, 'c10'])})"


@query(
    "normalization_audit",
    f"""WITH s AS (SELECT split, class_id, count(*) AS n_windows, CAST(sum(len(samples)) AS BIGINT) AS n_values,
          CAST(sum(len(list_filter(samples, lambda x: x = 0))) AS BIGINT) AS n_at_floor,
          CAST(sum(len(list_filter(samples, lambda x: x >= 0.95::DOUBLE))) AS BIGINT) AS n_ge_095, sum(list_sum(samples)) AS s,
          sum(list_sum(list_transform(samples, lambda x: x * x))) AS q, sum(list_sum(samples[1:48])) AS ls, sum(list_sum(samples[49:64])) AS hs,
          CAST(sum(len(list_filter(samples[49:64], lambda x: x = 0))) AS BIGINT) AS hf FROM {SCALED_SQL} GROUP BY ALL)
        SELECT g.split, g.class_id, g.class_name, coalesce(n_windows, 0) AS n_windows, coalesce(n_values, 0) AS n_values,
          coalesce(n_at_floor, 0) AS n_at_floor, coalesce(n_ge_095, 0) AS n_ge_095, round(n_at_floor / n_values::DOUBLE, 8) AS frac_at_floor,
          round(s / n_values, 8) AS mean_norm, round(sqrt(q / n_values - (s / n_values) ** 2), 8) AS std_norm,
          round(ls / (n_values * 0.75::DOUBLE), 8) AS mean_low_bands, round(hs / (n_values * 0.25::DOUBLE), 8) AS mean_high_bands,
          round(hf / (n_values * 0.25::DOUBLE), 8) AS frac_at_floor_high_bands, round(n_ge_095 / n_values::DOUBLE, 8) AS frac_ge_095
        FROM {split_classes_sql()} g LEFT JOIN s ON s.split = g.split AND s.class_id = g.class_id""",
)
def normalization_audit(spark, sf):
    out = op.normalization_audit(
        scaled_features(spark, sf), "samples", taxonomy(spark, [*DIGITS, "c10"]), ("train", "val", "test"), 48
    )
    floats = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.round(c, 8) for c in floats})


@query(
    "bounds_scope_check",
    f"""SELECT 'GLOBAL' AS scope, min(value) + 0.0 AS lo, max(value) + 0.0 AS hi FROM events UNION ALL
        SELECT 'NOT GLOBAL', min(value) FILTER (WHERE {hash_split_sql('event_id')} = 'train') + 0.0, max(value) FILTER (WHERE {hash_split_sql('event_id')} = 'val') + 0.0 FROM events""",
)
def bounds_scope_check(spark, sf):
    rows = table(spark, sf, "events").withColumn("split", hash_split("event_id"))
    one = rows.agg(F.min("value").alias("db_min"), F.max("value").alias("db_max"))
    per_split = rows.agg(
        F.min(F.when(F.col("split") == "train", F.col("value"))).alias("db_min_train"),
        F.max(F.when(F.col("split") == "val", F.col("value"))).alias("db_max_val"),
    )
    splits = ("train", "val", "test")

    def with_scope(stats):
        lo, hi = stats.columns
        scope = op.bounds_scope_check(stats, "db_min", "db_max", splits).scalar()
        return stats.select(scope.alias("scope"), (F.col(lo) + 0.0).alias("lo"), (F.col(hi) + 0.0).alias("hi"))

    return with_scope(one).unionByName(with_scope(per_split))


def clip_windows(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id")).agg(F.count(F.lit(1)).alias("n_windows"))
    return clips(spark, sf).join(counts, "clip_id", "left")


CLIP_WINDOWS_SQL = f"(SELECT c.*, n_windows FROM {CLIPS_SQL} c LEFT JOIN (SELECT l_orderkey, count(*) AS n_windows FROM lineitem GROUP BY ALL) ON l_orderkey = clip_id)"


@query(
    "class_source_confounding",
    f"""SELECT project_class, source_dataset, n_clips, n_windows, round(n_clips / cs::DOUBLE, 9) AS clip_share, round(n_windows / ws::DOUBLE, 9) AS window_share,
          n_clips / cs::DOUBLE > 0.8::DOUBLE OR n_windows / ws::DOUBLE > 0.8::DOUBLE AS flag_over_80 FROM (
          SELECT *, sum(n_clips) OVER (PARTITION BY project_class) AS cs, sum(n_windows) OVER (PARTITION BY project_class) AS ws FROM (
            SELECT project_class, source_dataset, count(*) AS n_clips, CAST(sum(coalesce(n_windows, 0)) AS BIGINT) AS n_windows FROM {CLIP_WINDOWS_SQL} GROUP BY ALL))""",
)
def class_source_confounding(spark, sf):
    out = op.class_source_confounding(clip_windows(spark, sf), "project_class", "source_dataset")
    return out.withColumns({c: F.round(c, 9) for c in ("clip_share", "window_share")})


RATE_SQL = f"(SELECT project_class, class_id, CASE WHEN clip_id % 13 <> 4 THEN 8000 * (1 + clip_id % 3) END AS sample_rate FROM {CLIPS_SQL})"


def rates(spark, sf):
    rate = F.when(F.col("clip_id") % 13 != 4, 8000 * (1 + F.col("clip_id") % 3))
    return clips(spark, sf).select("project_class", "class_id", rate.alias("sample_rate"))


@query(
    "class_rate_confounding",
    f"""SELECT project_class, coalesce(sample_rate, -1) AS sample_rate, n_clips, round(n_clips / t::DOUBLE, 9) AS clip_share,
          sample_rate IS NULL AS sample_rate_missing, n_clips / t::DOUBLE > 0.8::DOUBLE AS flag_single_rate FROM (
          SELECT *, sum(n_clips) OVER (PARTITION BY project_class) AS t FROM (SELECT project_class, sample_rate, count(*) AS n_clips FROM {RATE_SQL} GROUP BY ALL))""",
)
def class_rate_confounding(spark, sf):
    return op.class_rate_confounding(rates(spark, sf), "project_class", "sample_rate").withColumn(
        "clip_share", F.round("clip_share", 9)
    )


@query(
    "zero_window_report",
    f"""SELECT split, project_class, count(*) AS n_zero_window FROM (SELECT *, {hash_split_sql('clip_id')} AS split FROM {CLIP_WINDOWS_SQL})
        WHERE n_windows IS NULL GROUP BY ALL""",
)
def zero_window_report(spark, sf):
    rows = clips(spark, sf).withColumn("split", hash_split("clip_id"))
    windows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip_id"))
    return op.zero_window_report(rows, windows, "clip_id", ["split", "project_class"])


@query(
    "below_threshold_share",
    f"""SELECT t.class_id, t.class_name, count(r.project_class) AS total, count(*) FILTER (WHERE sample_rate < 16000) AS below,
          count(*) FILTER (WHERE sample_rate < 16000) / nullif(count(r.project_class), 0)::DOUBLE AS share
        FROM {taxonomy_sql([*ORDER_CLASSES, "6-NONE"])} t LEFT JOIN {RATE_SQL} r ON r.project_class = t.class_name GROUP BY ALL""",
)
def below_threshold_share(spark, sf):
    return op.below_threshold_share(
        rates(spark, sf), taxonomy(spark, [*ORDER_CLASSES, "6-NONE"]), "project_class", "sample_rate", 16000
    )


def vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("split", hash_split("vec_id"))


VECTORS_SQL = f"(SELECT vec_id, label, embedding, {hash_split_sql('vec_id')} AS split FROM embeddings)"
CENTROID_SQL = f"""(SELECT label, list(m ORDER BY pos) AS centroid, max(n) AS n_train FROM (SELECT label, pos, avg(x) AS m, count(*) AS n FROM (
  SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM {VECTORS_SQL} WHERE split = 'train') GROUP BY ALL) GROUP BY label)"""


@query(
    "class_centroids",
    f"SELECT label, n_train, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(centroid), 9) + 0.0 AS x FROM {CENTROID_SQL}",
)
def class_centroids(spark, sf):
    c = op.class_centroids(vectors(spark, sf), "embedding", "label")
    return c.select("label", "n_train", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 9))


MARGIN_SQL = f"""(SELECT v.vec_id, v.label, v.split, min(CASE WHEN c.label <> v.label THEN d END) - min(CASE WHEN c.label = v.label THEN d END) AS margin
  FROM (SELECT v.vec_id, v.label, v.split, c.label AS cl, list_sum(list_transform(list_zip(v.embedding::DOUBLE[], c.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM {VECTORS_SQL} v, {CENTROID_SQL} c) v JOIN (SELECT label FROM {CENTROID_SQL}) c ON c.label = v.cl GROUP BY ALL)"""


def margins(spark, sf):
    rows = vectors(spark, sf)
    out = op.centroid_margins(rows, "embedding", "label", op.class_centroids(rows, "embedding", "label"))
    return out.select("vec_id", "label", "split", "margin")


SUPPORT_SQL = f"""(SELECT split, label, count(*) AS n_windows, count(*) FILTER (WHERE margin <= 0) / count(*)::DOUBLE AS frac_centroid_confusable,
  round(avg(margin), 8) AS mean_margin, round(quantile_cont(margin, 0.5), 8) AS median_margin FROM {MARGIN_SQL} GROUP BY ALL)"""


def support(spark, sf):
    out = op.margin_support(margins(spark, sf), ["split", "label"])
    return out.withColumns({"mean_margin": F.round("mean_margin", 8), "median_margin": F.round("median_margin", 8)})


@query("centroid_margin", f"SELECT split, label, n_windows, frac_centroid_confusable, mean_margin + 0.0 AS mean_margin, median_margin + 0.0 AS median_margin FROM {SUPPORT_SQL}")
def centroid_margin(spark, sf):
    return support(spark, sf)


@query(
    "worst_k",
    f"SELECT split, label, frac_centroid_confusable FROM {SUPPORT_SQL} ORDER BY frac_centroid_confusable DESC, split, label LIMIT 5",
)
def worst_k(spark, sf):
    return op.worst_k(
        support(spark, sf).select("split", "label", "frac_centroid_confusable"), "frac_centroid_confusable", ["split", "label"]
    )


@query(
    "class_weights",
    f"""SELECT label, n, t / (c * n)::DOUBLE AS weight, t / (2 * n)::DOUBLE AS weight_one, t / (2 * (t - n))::DOUBLE AS weight_rest FROM (
          SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS t, count(*) OVER () AS c FROM {VECTORS_SQL} WHERE split = 'train' GROUP BY label)""",
)
def class_weights(spark, sf):
    train = vectors(spark, sf).filter("split = 'train'")
    return op.class_weights(train, "label", taxonomy(spark, DIGITS))


@query(
    "dataset_contract_check",
    f"""SELECT * FROM (SELECT 'wrong_shape' AS "check", count(*) FILTER (WHERE len(samples) <> 64) AS n FROM {BROKEN_SQL}
          UNION ALL SELECT 'label_out_of_range', count(*) FILTER (WHERE class_id NOT BETWEEN 0 AND 9) FROM {BROKEN_SQL}
          UNION ALL SELECT 'value_out_of_range', count(*) FILTER (WHERE list_min(samples) < 0 OR list_max(samples) > 1) FROM {BROKEN_SQL}
          UNION ALL SELECT 'window_count_differs', 1) WHERE n > 0""",
)
def dataset_contract_check(spark, sf):
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
    expected = expected.withColumn("windows", F.when(F.col("split") == "val", -1).otherwise(F.col("windows")))
    return op.dataset_contract_check(broken, "samples", "class_id", 64, 10, expected)


@query(
    "window_label_consistency",
    f"""SELECT clip_id, CASE WHEN lo <> hi THEN 'several_labels' ELSE 'differs_from_splits' END AS problem FROM (
          SELECT l_orderkey AS clip_id, min(lab) AS lo, max(lab) AS hi, min(class_id) AS truth FROM (
            SELECT l_orderkey, class_id, CASE WHEN l_orderkey % 19 = 4 AND l_linenumber > 3 THEN 9 WHEN l_orderkey % 23 = 5 THEN 8 ELSE class_id END AS lab
            FROM lineitem JOIN {CLIPS_SQL} c ON c.clip_id = l_orderkey) GROUP BY ALL) WHERE lo <> hi OR lo <> truth""",
)
def window_label_consistency(spark, sf):
    base = clips(spark, sf).select("clip_id", "class_id")
    lab = (
        F.when((F.col("clip_id") % 19 == 4) & (F.col("l_linenumber") > 3), 9)
        .when(F.col("clip_id") % 23 == 5, 8)
        .otherwise(F.col("class_id"))
    )
    windows = (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("clip_id"), "l_linenumber")
        .join(base, "clip_id")
        .select("clip_id", lab.alias("class_id"))
    )
    return op.window_label_consistency(windows, base, "clip_id", "class_id")
