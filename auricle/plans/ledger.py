"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators import ledger as op
from .fixtures import DOCUMENTS_SQL, LANG_CLASSES, documents, taxonomy, taxonomy_sql
from .health import HEALTH_SQL, file_health
from .registry import query, table


@query(
    "ledger_alignment_check",
    """SELECT count(*) FILTER (WHERE a.n > 1) AS left_duplicates, count(*) FILTER (WHERE b.n > 1) AS right_duplicates,
         count(*) FILTER (WHERE a.n IS NULL) AS missing_left, count(*) FILTER (WHERE b.n IS NULL) AS missing_right
       FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY k) a
       FULL OUTER JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY k) b ON a.k = b.k""",
)
def ledger_alignment_check(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return checks.pairing_report(a, b, ["k"])


REASON_SQL = """array_to_string(list_filter([CASE WHEN list_contains(flags, 'extreme_short') THEN 'extreme_short(<0.5s)' END,
  CASE WHEN list_contains(flags, 'silent') THEN 'silent(RMS<=-60dBFS)' END], lambda x: x IS NOT NULL), ';')"""


@query(
    "exclusion_reason",
    f"SELECT doc_id, {REASON_SQL} AS reason, CASE WHEN {REASON_SQL} = '' THEN 'kept' ELSE 'excluded' END AS status FROM {HEALTH_SQL}",
)
def exclusion_reason(spark, sf):
    rows = file_health(spark, sf).select("doc_id", op.exclusion_reason("flags").alias("reason"))
    return rows.withColumn("status", op.status_of("reason"))


@query(
    "class_id_lookup",
    f"""SELECT d.doc_id, d.lang AS project_class, t.class_id FROM documents d
        LEFT JOIN {taxonomy_sql(LANG_CLASSES[:3])} t ON d.lang = t.class_name""",
)
def class_id_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("project_class"))
    return op.class_id_lookup(docs, taxonomy(spark, LANG_CLASSES[:3]), "project_class", strict=False).select(
        "doc_id", "project_class", "class_id"
    )


@query(
    "clip_key_unique",
    "SELECT l_orderkey || '/' || l_linenumber AS clip_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def clip_key_unique(spark, sf):
    rows = table(spark, sf, "lineitem").select(op.clip_key("l_orderkey", "l_linenumber").alias("clip_id"))
    return checks.duplicate_keys(rows, ["clip_id"])


def source_ids(spark, sf):
    """Order ids written in the three forms of source ids; every 7th subject id is malformed."""
    h = F.md5(F.col("o_custkey").cast("string"))
    uuid = F.concat_ws("-", F.upper(F.substring(h, 1, 8)), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    kind = F.col("o_orderkey") % 3
    sid = (
        F.when(F.col("o_orderkey") % 21 == 0, F.concat(F.lit("donateacry:"), F.substring(h, 1, 12)))
        .when(kind == 0, F.concat(F.lit("donateacry:"), uuid, F.lit("-1"), F.col("o_orderkey")))
        .when(kind == 1, F.concat(F.lit("recanvo:"), F.date_format("o_orderdate", "yyMMdd"), F.lit("_1200_"), F.col("o_orderkey")))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source_dataset"), sid.alias("source_id"))


H = "md5(CAST(o_custkey AS VARCHAR))"
SOURCE_IDS_SQL = f"""(SELECT o_orderkey, o_orderstatus AS source_dataset,
  CASE WHEN o_orderkey % 21 = 0 THEN 'donateacry:' || substr({H}, 1, 12)
       WHEN o_orderkey % 3 = 0 THEN 'donateacry:' || upper(substr({H}, 1, 8)) || '-' || substr({H}, 9, 4) || '-' || substr({H}, 13, 4)
         || '-' || substr({H}, 17, 4) || '-' || substr({H}, 21, 12) || '-1' || o_orderkey
       WHEN o_orderkey % 3 = 1 THEN 'recanvo:' || strftime(o_orderdate, '%y%m%d') || '_1200_' || o_orderkey
       ELSE CAST(o_custkey AS VARCHAR) END AS source_id FROM orders)"""


@query(
    "group_key_derive",
    f"""SELECT o_orderkey, CASE
          WHEN starts_with(source_id, 'donateacry:') THEN 'babycry/donateacry:' || lower(nullif(regexp_extract(source_id,
            '{op.SUBJECT_UUID}', 1), ''))
          WHEN starts_with(source_id, 'recanvo:') THEN 'babycry/recanvo:' || nullif(regexp_extract(source_id,
            '{op.SESSION_PREFIX}', 1), '')
          ELSE lower(source_dataset) || '/' || source_id END AS group_key FROM {SOURCE_IDS_SQL}""",
)
def group_key_derive(spark, sf):
    return source_ids(spark, sf).select("o_orderkey", op.group_key("source_dataset", "source_id").alias("group_key"))


@query(
    "truncate_duration",
    f"""SELECT doc_id, duration > 15 AND kept AS truncated, CASE WHEN kept THEN least(duration, 15.0::DOUBLE) END
          AS processed_duration_s FROM (SELECT doc_id, duration, duration >= 0.5 AS kept FROM {DOCUMENTS_SQL})""",
)
def truncate_duration(spark, sf):
    kept = F.col("duration") >= 0.5
    return documents(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in op.truncate_duration("duration", kept).items()]
    )


def document_ledger(spark, sf):
    manifest = documents(spark, sf).select(
        "doc_id",
        "source_dataset",
        "source_file",
        F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("source_id"),
        F.upper("project_class").alias("original_label"),
        "project_class",
        F.lit("CC0").alias("license"),
        F.lit("https://example.org").alias("source_url"),
        F.concat(F.lit("raw/"), "source_file").alias("local_path"),
    )
    health = file_health(spark, sf).select(
        "doc_id",
        F.col("duration").alias("duration_s"),
        "sample_rate",
        "channels",
        "rms_db",
        F.lit(0.5).alias("peak"),
        "sha256",
        "flags",
    )
    return op.clip_ledger(manifest, health, taxonomy(spark, LANG_CLASSES), "doc_id")


LEDGER_SQL = f"""(SELECT source_dataset || '/doc_' || doc_id || '.txt' AS clip_id, source_dataset, 'doc_' || doc_id || '.txt' AS source_file,
  's' || (doc_id % 50) AS source_id, lower(source_dataset) || '/s' || (doc_id % 50) AS group_key,
  upper(project_class) AS original_label, project_class, t.class_id, 'CC0' AS license, 'https://example.org' AS source_url,
  'raw/doc_' || doc_id || '.txt' AS local_path, duration AS duration_s, sample_rate, channels, rms_db,
  0.5::DOUBLE AS peak, sha256, array_to_string(flags, ',') AS health_flags,
  CASE WHEN {REASON_SQL} = '' THEN 'kept' ELSE 'excluded' END AS status, {REASON_SQL} AS reason,
  duration > 15 AND {REASON_SQL} = '' AS truncated,
  CASE WHEN {REASON_SQL} = '' THEN least(duration, 15.0::DOUBLE) END AS processed_duration_s,
  CASE WHEN {REASON_SQL} = '' THEN 16000.0::DOUBLE END AS resample_sr, CASE WHEN {REASON_SQL} = '' THEN TRUE END AS mono,
  CASE WHEN {REASON_SQL} = '' THEN 3200.0::DOUBLE END AS window_samples,
  CASE WHEN {REASON_SQL} = '' THEN 1600.0::DOUBLE END AS window_step_samples,
  CASE WHEN {REASON_SQL} = '' THEN 0.0::DOUBLE END AS pad_fraction
  FROM {HEALTH_SQL} h JOIN {taxonomy_sql(LANG_CLASSES)} t ON h.project_class = t.class_name)"""


@query("clip_ledger", f"SELECT * FROM {LEDGER_SQL}")
def clip_ledger(spark, sf):
    return document_ledger(spark, sf)


@query("ledger_reason_counts", f"SELECT status, reason, count(*) AS n FROM {LEDGER_SQL} GROUP BY ALL")
def ledger_reason_counts(spark, sf):
    return op.ledger_reason_counts(document_ledger(spark, sf))
