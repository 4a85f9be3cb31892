"""Health and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as op
from .fixtures import CLIPS_SQL, DOCUMENTS_SQL, SIGNALS_SQL, clips, documents, signals
from .registry import query, table


# The unit vectors peak well below full scale: amplify by 2.5, so that some samples clip.
def loud(spark, sf):
    return signals(spark, sf).select(
        "clip_id",
        "class_id",
        F.transform("samples", lambda x: F.least(x.cast("double") * 2.5, F.lit(1.0))).alias("samples"),
    )


LOUD_SQL = f"""(SELECT clip_id, class_id, list_transform(samples, lambda x: least(x::DOUBLE * 2.5::DOUBLE, 1.0::DOUBLE))
  AS samples FROM {SIGNALS_SQL})"""
SIGNAL_SQL = f"""(SELECT clip_id, class_id, len(samples) / 100.0::DOUBLE AS duration,
  20 * log10(sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples))) AS rms_db,
  list_max(list_transform(samples, lambda x: abs(x))) AS peak,
  len(list_filter(samples, lambda x: abs(x) >= 0.999::DOUBLE)) / len(samples)::DOUBLE AS clip_frac FROM {LOUD_SQL})"""


@query(
    "signal_health",
    f"""SELECT clip_id, duration, round(rms_db, 6) AS rms_db, round(peak, 6) AS peak, clip_frac FROM {SIGNAL_SQL}""",
)
def signal_health(spark, sf):
    m = op.signal_health("samples", F.lit(100.0))
    return loud(spark, sf).select(
        "clip_id",
        m["duration"].alias("duration"),
        F.round(m["rms_db"], 6).alias("rms_db"),
        F.round(m["peak"], 6).alias("peak"),
        m["clip_frac"].alias("clip_frac"),
    )


# Health rows of the documents: level from the share of letters "e", declared hash broken for some.
def file_health(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("source_dataset"),
        F.col("lang").alias("project_class"),
        (F.col("n_chars") / 500.0).alias("duration"),
        (F.lit(-80.0) + F.pmod(F.col("doc_id") * 7, F.lit(80))).alias("rms_db"),
        (F.pmod(F.col("doc_id"), F.lit(400)) / 100000.0).alias("clip_frac"),
        (F.col("doc_id") % 97 != 5).alias("exists"),
        F.when(F.col("doc_id") % 89 == 3, "unreadable:OSError").when(F.col("doc_id") % 83 == 2, "zero_byte").alias("error"),
        F.sha2("text", 256).alias("sha256"),
        F.when(F.col("doc_id") % 3 != 0, F.sha2(F.rtrim("text"), 256)).alias("v_sha256"),
        (8000 * (1 + F.col("doc_id") % 3)).alias("sample_rate"),
        (1 + F.col("doc_id") % 2).alias("channels"),
        (F.col("doc_id") % 50).alias("group_key"),
    )
    docs = docs.withColumn("sha_match", op.hash_match("sha256", "v_sha256"))
    return docs.withColumns(op.health_flags("duration", "rms_db", "clip_frac", "exists", "error", "sha_match"))


HEALTH_BASE_SQL = """(SELECT doc_id, source AS source_dataset, lang AS project_class, n_chars / 500.0::DOUBLE AS duration,
  -80.0::DOUBLE + (doc_id * 7) % 80 AS rms_db, (doc_id % 400) / 100000.0::DOUBLE AS clip_frac, doc_id % 97 <> 5 AS exists_,
  CASE WHEN doc_id % 89 = 3 THEN 'unreadable:OSError' WHEN doc_id % 83 = 2 THEN 'zero_byte' END AS error,
  sha256(text) AS sha256, CASE WHEN doc_id % 3 <> 0 THEN sha256(rtrim(text, ' ')) END AS v_sha256,
  8000 * (1 + doc_id % 3) AS sample_rate, 1 + doc_id % 2 AS channels, doc_id % 50 AS group_key FROM documents)"""
HEALTH_SQL = f"""(SELECT *, sha256 = v_sha256 AS sha_match, list_filter([
  CASE WHEN NOT exists_ THEN 'missing' END, CASE WHEN error IN ('zero_byte','zero_frames') THEN 'zero_length' END,
  CASE WHEN error LIKE 'unreadable%' THEN 'unreadable' END, CASE WHEN duration < 0.5 THEN 'extreme_short' END,
  CASE WHEN duration >= 0.5 AND duration < 1 THEN 'short' END, CASE WHEN duration > 15 AND duration <= 30 THEN 'long' END,
  CASE WHEN duration > 30 THEN 'very_long' END, CASE WHEN rms_db <= -60 THEN 'silent' END,
  CASE WHEN rms_db > -60 AND rms_db <= -45 THEN 'low_energy' END, CASE WHEN clip_frac >= 0.001::DOUBLE THEN 'clipped' END,
  CASE WHEN sha256 <> v_sha256 THEN 'sha_mismatch' END], lambda x: x IS NOT NULL) AS flags FROM {HEALTH_BASE_SQL})"""


@query(
    "health_flags",
    f"SELECT doc_id, array_to_string(flags, ',') AS flags, CAST(len(flags) AS BIGINT) AS n_flags FROM {HEALTH_SQL}",
)
def health_flags(spark, sf):
    return file_health(spark, sf).select(
        "doc_id", F.array_join("flags", ",").alias("flags"), F.col("n_flags").cast("bigint").alias("n_flags")
    )


@query("hash_match", f"SELECT doc_id, sha_match FROM {HEALTH_SQL}")
def hash_match(spark, sf):
    return file_health(spark, sf).select("doc_id", "sha_match")


@query(
    "inventory_reconcile",
    """SELECT state, count(*) AS n FROM (
         SELECT CASE WHEN o.k IS NULL THEN 'only_on_disk' WHEN l.k IS NULL THEN 'only_listed' ELSE 'both' END AS state
         FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 3) o
         FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k) GROUP BY state""",
)
def inventory_reconcile(spark, sf):
    listed = table(spark, sf, "orders").filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("path"))
    disk = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"))
    return op.inventory_reconcile(listed, disk, "path").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_content_groups",
    f"""WITH g AS (SELECT sha256, count(*) AS n, array_to_string(list_sort(list_distinct(list(source_dataset))), '|') AS sources,
           array_to_string(list_sort(list_distinct(list(project_class))), '|') AS classes
         FROM {DOCUMENTS_SQL} GROUP BY sha256 HAVING count(*) > 1)
        SELECT g.sha256, g.n, g.sources, g.classes, d.source_file FROM g JOIN {DOCUMENTS_SQL} d USING (sha256)""",
)
def duplicate_content_groups(spark, sf):
    docs = documents(spark, sf)
    groups = op.duplicate_content_groups(docs, "sha256", "source_dataset", "project_class")
    named = groups.withColumns({c: F.array_join(c, "|") for c in ("sources", "classes")})
    return op.duplicate_members(docs.select("sha256", "source_file"), named, "sha256")


@query(
    "cross_source_class_duplicates",
    f"""SELECT sha256, count(*) AS n, count(DISTINCT source_dataset) > 1 AS cross_source,
          count(DISTINCT project_class) > 1 AS cross_class FROM {DOCUMENTS_SQL} GROUP BY sha256
        HAVING count(DISTINCT source_dataset) > 1 OR count(DISTINCT project_class) > 1""",
)
def cross_source_class_duplicates(spark, sf):
    groups = op.duplicate_content_groups(documents(spark, sf), "sha256", "source_dataset", "project_class")
    return groups.select(
        "sha256", "n", (F.size("sources") > 1).alias("cross_source"), (F.size("classes") > 1).alias("cross_class")
    ).filter("cross_source OR cross_class")


@query(
    "source_group_stats",
    f"""SELECT group_key, count(*) AS n_clips, count(DISTINCT project_class) AS n_classes,
          array_to_string(list_sort(list_distinct(list(project_class))), ';') AS classes,
          array_to_string(list_sort(list_distinct(list(source_dataset))), ';') AS datasets, count(*) > 1 AS multi_clip,
          count(DISTINCT project_class) > 1 AS cross_class
        FROM {CLIPS_SQL} GROUP BY group_key ORDER BY n_clips DESC, group_key LIMIT 25""",
)
def source_group_stats(spark, sf):
    stats = op.source_group_stats(clips(spark, sf), "group_key", "project_class", "source_dataset")
    return (
        stats.select(
            "group_key",
            "n_clips",
            "n_classes",
            F.array_join("classes", ";").alias("classes"),
            F.array_join("datasets", ";").alias("datasets"),
            (F.col("n_clips") > 1).alias("multi_clip"),
            (F.col("n_classes") > 1).alias("cross_class"),
        )
        .orderBy(F.col("n_clips").desc(), "group_key")
        .limit(25)
    )


SUBJECT = r"donateacry:([0-9a-f-]+?)-[0-9]{13}-"
SUBJECT_ID = "'donateacry:' || substr(md5(CAST({c} AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST({c} AS VARCHAR)), 9, 4) || '-1410000' || lpad(CAST({o} AS VARCHAR), 6, '0') || '-x'"


@query(
    "subject_extract",
    f"""SELECT subject, count(*) AS n FROM (
          SELECT CASE WHEN starts_with(sid, 'donateacry:') THEN nullif(regexp_extract(sid, '{SUBJECT}', 1), '') ELSE sid END
            AS subject FROM (
            SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'recanvo:' || o_custkey
                   ELSE {SUBJECT_ID.format(c="o_custkey", o="o_orderkey")} END AS sid FROM orders))
        GROUP BY subject""",
)
def subject_extract(spark, sf):
    key = F.md5(F.col("o_custkey").cast("string"))
    tagged = F.concat(
        F.lit("donateacry:"), F.substring(key, 1, 8), F.lit("-"), F.substring(key, 9, 4),
        F.lit("-1410000"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("-x"),
    )
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("recanvo:"), F.col("o_custkey"))).otherwise(tagged).alias("sid")
    )
    return rows.groupBy(op.subject_of("sid", "donateacry:", SUBJECT).alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_table",
    f"""SELECT source_dataset, label, project_class, count(*) AS n FROM (
          SELECT source_dataset, project_class, 'q' || (1 + (days // 92) % 4) AS label FROM {CLIPS_SQL})
        GROUP BY ALL ORDER BY n DESC""",
)
def label_table(spark, sf):
    rows = clips(spark, sf).withColumn("label", F.concat(F.lit("q"), 1 + F.expr("days div 92") % 4))
    return (
        rows.groupBy("source_dataset", "label", "project_class")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "source_dataset", "label", "project_class")
    )


PATTERNS = (("STANDARD", "red|hot"), ("PROMO", "widget"), ("SMALL", "ring|rod"), ("LARGE", "zzz"))


@query(
    "label_ambiguity",
    f"""WITH p AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PATTERNS)}) AS t(project_class, pattern)),
        r AS (SELECT p_partkey, p_type AS project_class, p_name AS label, regexp_matches(lower(p_name), pattern) AS hit
              FROM part JOIN p ON p.project_class = part.p_type)
        SELECT project_class, count(*) AS n, count(*) FILTER (WHERE hit) AS ambiguous_n,
          array_to_string((list(label ORDER BY p_partkey) FILTER (WHERE hit))[1:3], '|') AS examples
        FROM r GROUP BY project_class""",
)
def label_ambiguity(spark, sf):
    patterns = spark.createDataFrame(list(PATTERNS), "project_class string, pattern string")
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_type project_class", "p_name label")
    out = op.label_ambiguity(rows, patterns, "project_class", "label", "p_partkey")
    return out.withColumn("examples", F.array_join("examples", "|"))


DUR_SQL = """min(n) AS min, quantile_cont(n, 0.5) AS median, CAST(sum(n) AS DOUBLE) / count(*) AS mean, max(n) AS max,
  round(stddev_samp(n), 4) AS std, CAST(sum(n) AS DOUBLE) / 3600 AS total_hours"""


@query(
    "duration_stats",
    f"""SELECT coalesce(project_class, 'ALL') AS project_class, count(*) AS n, {DUR_SQL}
        FROM (SELECT lang AS project_class, CAST(n_chars AS DOUBLE) AS n FROM documents)
        GROUP BY GROUPING SETS ((project_class), ())""",
)
def duration_stats(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("project_class"), F.col("n_chars").cast("double").alias("duration")
    )
    return op.duration_stats(docs, "project_class", "duration").withColumn("std", F.round("std", 4))


@query(
    "frequency_map",
    f"""SELECT project_class, string_agg(sample_rate || 'Hz:' || n, ',' ORDER BY sample_rate) AS sample_rates
        FROM (SELECT project_class, sample_rate, count(*) AS n FROM {HEALTH_SQL} GROUP BY ALL) GROUP BY project_class""",
)
def frequency_map(spark, sf):
    return op.frequency_map(file_health(spark, sf), ["project_class"], "sample_rate", "Hz", "sample_rates")


@query(
    "split_feasibility",
    f"""SELECT project_class, CAST(sum(n) AS BIGINT) AS n_clips, count(*) AS n_source_groups,
          count(*) FILTER (WHERE n > 1) AS multi_clip_groups, max(n) AS max_group_size,
          round(max(n) / sum(n)::DOUBLE, 3) AS max_group_share, 3 AS groups_needed_min,
          CASE WHEN count(*) >= 20 AND max(n) / sum(n)::DOUBLE <= 0.2::DOUBLE THEN 'FEASIBLE' WHEN count(*) >= 7
               THEN 'MARGINAL' ELSE 'INFEASIBLE' END AS verdict
        FROM (SELECT project_class, group_key, count(*) AS n FROM (
                SELECT project_class, group_key FROM {CLIPS_SQL} UNION ALL
                SELECT 'lang-' || project_class, length(source_dataset) FROM {DOCUMENTS_SQL}) GROUP BY ALL)
        GROUP BY project_class""",
)
def split_feasibility(spark, sf):
    rows = clips(spark, sf).select("project_class", "group_key").union(
        documents(spark, sf).select(
            F.concat(F.lit("lang-"), "project_class"), F.length("source_dataset").cast("bigint")
        )
    )
    return op.split_feasibility(rows, "project_class", "group_key")


@query(
    "suspicious_topk",
    f"""SELECT doc_id, CAST(len(flags) AS BIGINT) AS n_flags, array_to_string(flags, ',') AS flags FROM {HEALTH_SQL}
        WHERE len(flags) > 0 ORDER BY n_flags DESC, doc_id LIMIT 100""",
)
def suspicious_topk(spark, sf):
    rows = file_health(spark, sf).select(
        "doc_id", F.col("n_flags").cast("bigint").alias("n_flags"), F.array_join("flags", ",").alias("flags")
    )
    return op.suspicious_topk(rows, "n_flags", "doc_id", 100)


@query(
    "class_summary",
    f"""WITH h AS (SELECT * EXCLUDE (duration), n_chars_::DOUBLE AS duration FROM (
            SELECT *, CAST(round(duration * 500) AS BIGINT) AS n_chars_ FROM {HEALTH_SQL})),
        g AS (SELECT project_class, count(*) AS source_group_count, count(*) FILTER (WHERE n > 1) AS multi_clip_groups,
                max(n) AS max_group_size FROM (SELECT project_class, group_key, count(*) AS n FROM h GROUP BY ALL)
              GROUP BY project_class),
        f AS (SELECT project_class, string_agg(sample_rate || 'Hz:' || n, ',' ORDER BY sample_rate) AS sample_rate_summary
              FROM (SELECT project_class, sample_rate, count(*) AS n FROM h GROUP BY ALL) GROUP BY project_class),
        c AS (SELECT project_class, string_agg(channels || 'ch:' || n, ',' ORDER BY channels) AS channel_summary
              FROM (SELECT project_class, channels, count(*) AS n FROM h GROUP BY ALL) GROUP BY project_class),
        w AS (SELECT project_class, count(*) AS total_clips, count(DISTINCT source_dataset) AS source_dataset_count,
                array_to_string(list_sort(list_distinct(list(source_dataset))), '|') AS sources,
                min(duration) AS min_duration, quantile_cont(duration, 0.5) AS median_duration,
                ((2000 * CAST(sum(duration) AS BIGINT) + count(*)) // (2 * count(*))) / 1000.0::DOUBLE AS mean_duration, max(duration) AS max_duration,
                ((2000 * CAST(sum(duration) AS BIGINT) + 3600) // 7200) / 1000.0::DOUBLE AS total_hours, count(*) FILTER (WHERE len(flags) > 0) AS suspicious_count,
                count(*) FILTER (WHERE list_contains(flags, 'silent')) AS silent_count,
                count(*) FILTER (WHERE list_contains(flags, 'low_energy')) AS low_energy_count,
                count(*) FILTER (WHERE duration < 1) AS short_count_lt1s, count(*) FILTER (WHERE duration > 15) AS long_count_gt15s,
                count(*) FILTER (WHERE list_contains(flags, 'clipped')) AS clipped_count FROM h GROUP BY project_class)
        SELECT * FROM w JOIN g USING (project_class) JOIN f USING (project_class) JOIN c USING (project_class)""",
)
def class_summary(spark, sf):
    rows = file_health(spark, sf).withColumn("duration", F.round(F.col("duration") * 500))
    return op.class_summary(rows, "project_class", "source_dataset", "group_key", "sample_rate", "channels")


@query(
    "flag_totals",
    f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {HEALTH_SQL}) GROUP BY flag",
)
def flag_totals(spark, sf):
    return op.flag_totals(file_health(spark, sf), "flags")


@query(
    "representative_pick",
    f"""WITH r AS (SELECT project_class, doc_id, duration, rms_db,
            row_number() OVER (PARTITION BY project_class ORDER BY duration, doc_id) - 1 AS k,
            count(*) OVER (PARTITION BY project_class) AS n,
            row_number() OVER (PARTITION BY project_class ORDER BY rms_db, doc_id) AS q FROM {HEALTH_SQL}),
        b AS (SELECT project_class, unnest(list_filter([CASE WHEN k = 0 THEN 'shortest' END, CASE WHEN k = n // 2 THEN
            'median' END, CASE WHEN k = n - 1 THEN 'longest' END], lambda x: x IS NOT NULL)) AS pick, doc_id, duration, rms_db
            FROM r)
        SELECT * FROM b UNION ALL SELECT project_class, 'lowest_energy', doc_id, duration, rms_db FROM r
        WHERE q = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND b.project_class = r.project_class)""",
)
def representative_pick(spark, sf):
    rows = file_health(spark, sf).select("project_class", "doc_id", "duration", "rms_db")
    return op.representative_pick(rows, "project_class", "duration", "rms_db", "doc_id")


FRAME_SQL = "s[16 * f + 1 : 16 * f + 16]"


@query(
    "signal_diagnostics",
    f"""WITH b AS (SELECT clip_id, samples::DOUBLE[] AS s FROM {SIGNALS_SQL}),
        h AS (SELECT clip_id, s, list_transform(range(64), lambda i: s[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 63))) AS w FROM b),
        k AS (SELECT clip_id, unnest(range(33)) AS k, w FROM h),
        p AS (SELECT clip_id, k * 100 / 64.0::DOUBLE AS hz, sqrt(list_sum(list_transform(range(64), lambda i: w[i + 1] * cos(2 * pi() * k * i / 64))) ** 2
               + list_sum(list_transform(range(64), lambda i: w[i + 1] * sin(2 * pi() * k * i / 64))) ** 2) AS m FROM k),
        c AS (SELECT clip_id, sum(hz * m) / (sum(m) + 1e-12) AS centroid FROM p GROUP BY clip_id),
        f AS (SELECT clip_id, unnest(range(4)) AS f, s FROM b),
        z AS (SELECT clip_id, avg(list_sum(list_transform(range(1, 16), lambda i: abs(sign({FRAME_SQL}[i + 1]) - sign({FRAME_SQL}[i])))) / 15) / 2 AS zcr,
               count(*) FILTER (WHERE 20 * log10(sqrt(list_sum(list_transform({FRAME_SQL}, lambda x: x * x)) / 16) + 1e-12) <= -60) / 4.0::DOUBLE AS silence_ratio
              FROM f GROUP BY clip_id)
        SELECT clip_id, round(list_sum(s) / 64, 8) + 0.0 AS dc_offset, silence_ratio, round(zcr, 8) AS zcr, round(centroid, 6) AS spectral_centroid_hz,
          round(list_max(list_transform(s, lambda x: abs(x))) / sqrt(list_sum(list_transform(s, lambda x: x * x)) / 64), 6) AS crest_factor
        FROM b JOIN c USING (clip_id) JOIN z USING (clip_id)""",
)
def signal_diagnostics(spark, sf):
    out = op.signal_diagnostics(signals(spark, sf), "clip_id", "samples", 100, 16)
    digits = {"dc_offset": 8, "zcr": 8, "spectral_centroid_hz": 6, "crest_factor": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
