"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import label_set
from ..operators import curation as op
from ..operators.ordered import exact_quantiles
from .fixtures import CLIPS_SQL, DOCUMENTS_SQL, clips, documents
from .registry import query, table

REGION_CLASS = {"AFRICA": "south", "ASIA": "east", "EUROPE": "north"}


@query(
    "label_map_filter",
    """SELECT c.c_custkey, n.n_name, m.project_class
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
       JOIN (VALUES ('AFRICA','south'),('ASIA','east'),('EUROPE','north')) AS m(r_name, project_class)
         ON r.r_name = m.r_name""",
)
def label_map_filter(spark, sf):
    mapping = spark.createDataFrame(list(REGION_CLASS.items()), "r_name string, project_class string")
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    mapped = op.label_map_filter(nations, mapping, "r_name")
    return (
        table(spark, sf, "customer")
        .join(mapped, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_name", "project_class")
    )


def part_labels(spark, sf):
    """Parts with a comma list of labels (name words and type)."""
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_size",
        F.concat_ws(",", F.replace("p_name", F.lit(" "), F.lit(" , ")), F.col("p_type")).alias("labels"),
    )


PARTS_SQL = "(SELECT p_partkey, p_size, replace(p_name, ' ', ' , ') || ',' || p_type AS labels FROM part)"
LABELS_SQL = "list_filter(list_transform(string_split(labels, ','), lambda x: lower(trim(x))), lambda x: x <> '')"


@query(
    "multilabel_match_any",
    f"SELECT p_partkey, labels FROM {PARTS_SQL} WHERE list_has_any({LABELS_SQL}, ['ring', 'promo'])",
)
def multilabel_match_any(spark, sf):
    return part_labels(spark, sf).filter(op.match_any(label_set("labels"), ["ring", "promo"])).drop("p_size")


def _fallback_sql(minimum):
    return f"""WITH p AS (SELECT p_partkey, list_has_all({LABELS_SQL}, ['red', 'promo']) AS a,
                 list_contains({LABELS_SQL}, 'red') AS o FROM {PARTS_SQL}),
       n AS (SELECT count(*) FILTER (WHERE a) AS n FROM p)
       SELECT p_partkey, 'x{minimum}' AS variant FROM p, n WHERE CASE WHEN n.n < {minimum} THEN o ELSE a END"""


@query("multilabel_match_all_fallback", f"{_fallback_sql(1)} UNION ALL ({_fallback_sql(1000000)})")
def multilabel_match_all_fallback(spark, sf):
    out = [
        op.match_all_or_fallback(part_labels(spark, sf), label_set("labels"), ["red", "promo"], "red", minimum)
        .select("p_partkey", F.lit(f"x{minimum}").alias("variant"))
        for minimum in (1, 1000000)
    ]
    return out[0].unionByName(out[1])


@query(
    "colabel_exclude",
    f"""SELECT p_partkey FROM {PARTS_SQL} WHERE list_contains({LABELS_SQL}, 'widget')
        AND NOT list_has_any({LABELS_SQL}, ['red', 'economy'])""",
)
def colabel_exclude(spark, sf):
    hits = part_labels(spark, sf).filter(op.match_any(label_set("labels"), ["widget"]))
    return op.exclude_colabels(hits, label_set("labels"), ["red", "economy"]).select("p_partkey")


@query(
    "source_whitelist_filter",
    f"""SELECT clip_id, source_dataset, project_class FROM {CLIPS_SQL}
        WHERE (source_dataset = 'F' AND project_class IN ('1-URGENT','5-LOW'))
           OR (source_dataset = 'O' AND cents >= 20000000 AND project_class IN ('2-HIGH','3-MEDIUM'))""",
)
def source_whitelist_filter(spark, sf):
    src, cls = F.col("source_dataset"), F.col("project_class")
    rules = [
        (src == "F") & cls.isin("1-URGENT", "5-LOW"),
        (src == "O") & (F.col("cents") >= 20000000) & cls.isin("2-HIGH", "3-MEDIUM"),
    ]
    return op.source_whitelist(clips(spark, sf), rules).select("clip_id", "source_dataset", "project_class")


@query(
    "leakage_guard_antijoin",
    """SELECT doc_id, sha256(text) AS sha256 FROM documents
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)
         AND sha256(text) NOT IN (SELECT sha256(text) FROM conversations)
         AND sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)""",
)
def leakage_guard_antijoin(spark, sf):
    docs = documents(spark, sf).select("doc_id", "sha256")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    used = [
        table(spark, sf, "benchmark").select(F.sha2("text", 256)),
        table(spark, sf, "conversations").select(F.sha2("text", 256)),
        docs.join(toxic, "doc_id", "left_semi").select("sha256"),
    ]
    return op.leakage_guard(docs, "sha256", used)


PRIORITY_SQL = f"""
WITH p AS (SELECT p_partkey, {LABELS_SQL} AS ls, md5('42:' || CAST(p_partkey AS VARCHAR)) AS k FROM {PARTS_SQL}),
r1 AS (SELECT *, CASE WHEN list_has_any(ls, ['ring']) THEN 'Ring' END AS c1 FROM p),
r2 AS (SELECT *, CASE WHEN c1 IS NULL AND list_has_any(ls, ['red','small']) AND
         row_number() OVER (PARTITION BY c1 IS NULL AND list_has_any(ls, ['red','small']) ORDER BY k, p_partkey) <= 30
         THEN 'RedSmall' ELSE c1 END AS c2 FROM r1),
r3 AS (SELECT *, CASE WHEN c2 IS NULL AND list_has_any(ls, ['widget']) THEN 'Widget' ELSE c2 END AS c3 FROM r2),
r4 AS (SELECT *, CASE WHEN c3 IS NULL AND list_has_any(ls, ['red','bolt']) AND
         row_number() OVER (PARTITION BY c3 IS NULL AND list_has_any(ls, ['red','bolt']) ORDER BY k, p_partkey) <= 25
         THEN 'RedBolt' ELSE c3 END AS c4 FROM r3)
SELECT p_partkey, c4 AS project_class FROM r4 WHERE c4 IS NOT NULL"""


@query("priority_assign", PRIORITY_SQL)
def priority_assign(spark, sf):
    labels = label_set("labels")
    rules = [
        op.Rule("Ring", op.match_any(labels, ["ring"])),
        op.Rule("RedSmall", op.match_any(labels, ["red", "small"]), cap=30),
        op.Rule("Widget", op.match_any(labels, ["widget"])),
        op.Rule("RedBolt", op.match_any(labels, ["red", "bolt"]), cap=25),
    ]
    return op.priority_assign(part_labels(spark, sf), "p_partkey", rules, seed=42).select(
        "p_partkey", "project_class"
    )


@query(
    "capped_sample_per_class",
    f"""SELECT clip_id, project_class FROM {CLIPS_SQL}
        QUALIFY row_number() OVER (PARTITION BY project_class
          ORDER BY md5('42:' || CAST(clip_id AS VARCHAR)), clip_id) <= 100""",
)
def capped_sample_per_class(spark, sf):
    rows = clips(spark, sf).select("clip_id", "project_class")
    return op.capped_sample(rows, ["project_class"], "clip_id", 100, seed=42)


DEFAULTS = {
    "F": {"license": "CC BY 4.0", "source_url": "https://example.org/f"},
    "O": {"license": "CC0"},
}


@query(
    "default_fill",
    """SELECT clip_id, source_dataset,
       CASE WHEN trim(license) <> '' THEN license WHEN source_dataset = 'F' THEN 'CC BY 4.0'
            WHEN source_dataset = 'O' THEN 'CC0' ELSE license END AS license,
       CASE WHEN trim(source_url) <> '' THEN source_url WHEN source_dataset = 'F' THEN 'https://example.org/f'
            ELSE source_url END AS source_url
       FROM (SELECT o_orderkey AS clip_id, o_orderstatus AS source_dataset,
               CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'own' END AS license,
               CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_custkey END AS source_url FROM orders)""",
)
def default_fill(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"),
        F.col("o_orderstatus").alias("source_dataset"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'own' END").alias("license"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat('u', o_custkey) END").alias("source_url"),
    )
    return op.default_fill(rows, "source_dataset", DEFAULTS)


@query(
    "derive_duration",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity
         ELSE round(l_extendedprice / 100 - l_quantity / 100, 4) END AS duration FROM lineitem""",
)
def derive_duration(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns(
        {
            "raw": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise(" "),
            "start": F.col("l_quantity") / 100,
            "end": F.col("l_extendedprice") / 100,
        }
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", op.derive_duration("raw", "start", "end").alias("duration")
    )


@query(
    "dedupe_keep_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""",
)
def dedupe_keep_first(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return op.dedupe_keep_first(
        rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]
    )


@query(
    "incremental_merge_keep_old",
    """WITH b AS (
         SELECT 0 AS b, c_custkey AS k, c_nationkey AS g, c_acctbal AS v, 'customer' AS origin FROM customer
         UNION ALL SELECT 1, s_suppkey * 10, s_nationkey, s_acctbal, 'supplier' FROM supplier)
       SELECT k, g, v, origin FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY b, g, v) = 1""",
)
def incremental_merge_keep_old(spark, sf):
    old = table(spark, sf, "customer").selectExpr(
        "c_custkey k", "c_nationkey g", "c_acctbal v", "'customer' origin"
    )
    new = table(spark, sf, "supplier").selectExpr(
        "s_suppkey * 10 k", "s_nationkey g", "s_acctbal v", "'supplier' origin"
    )
    return op.incremental_merge(old, new, ["k"], ["g", "v"])


RATES = (8000, 11025, 16000, 22050, 32000, 44100, 48000)  # fixed values: usual sample rates


@query(
    "validation_status",
    f"""WITH d AS (SELECT doc_id, duration, sample_rate, peak, declared FROM (
          SELECT doc_id, n_chars / 500.0::DOUBLE AS duration, 8000 + 50 * (doc_id % 800) AS sample_rate,
                 CASE WHEN n_chars < 200 THEN 0.00001 ELSE 0.5 END AS peak,
                 n_chars / 500.0::DOUBLE + (doc_id % 5) / 8.0::DOUBLE AS declared FROM documents))
       SELECT doc_id,
         CASE WHEN abs(duration - declared) > 0.35 THEN 'invalid'
              WHEN peak < 1e-4 OR sample_rate NOT IN {RATES} THEN 'warning' ELSE 'ok' END AS validation_status,
         CASE WHEN abs(duration - declared) > 0.35 THEN 'duration_mismatch'
              ELSE array_to_string(list_filter([CASE WHEN peak < 1e-4 THEN 'near_silent' END,
                CASE WHEN sample_rate NOT IN {RATES} THEN 'unusual_sr_' || sample_rate END], lambda x: x IS NOT NULL), ';')
         END AS v_notes FROM d""",
)
def validation_status(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id",
        "n_chars / 500.0D AS duration",
        "8000 + 50 * (doc_id % 800) AS sample_rate",
        "CASE WHEN n_chars < 200 THEN 0.00001D ELSE 0.5D END AS peak",
        "n_chars / 500.0D + (doc_id % 5) / 8.0D AS declared",
    )
    status = op.validation_status(
        invalid=[(F.abs(F.col("duration") - F.col("declared")) > 0.35, "duration_mismatch")],
        warnings=[
            (F.col("duration") <= 0, "zero_duration"),
            (F.col("peak") < 1e-4, "near_silent"),
            (~F.col("sample_rate").isin(*RATES), F.concat(F.lit("unusual_sr_"), F.col("sample_rate"))),
        ],
    )
    return docs.withColumns(status).select("doc_id", "validation_status", "v_notes")


KEYWORDS = (("blog.", "Blog"), ("page=", "Paged"), ("//m.", "Mobile"), (".html", "Static"), ("#top", "Anchor"))


@query(
    "keyword_classify",
    "SELECT page_id, url, CASE "
    + " ".join(f"WHEN contains(lower(url), '{k}') THEN '{v}'" for k, v in KEYWORDS)
    + " END AS project_class FROM pages",
)
def keyword_classify(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", op.keyword_classify("url", KEYWORDS).alias("project_class")
    )


@query(
    "label_vocabulary_counts",
    f"""SELECT t.label, coalesce(c.n, 0) AS n FROM (VALUES ('ring'),('widget'),('promo'),('siren'),('red')) AS t(label)
        LEFT JOIN (SELECT label, count(*) AS n FROM (SELECT unnest({LABELS_SQL}) AS label FROM {PARTS_SQL})
                   GROUP BY label) c ON t.label = c.label""",
)
def label_vocabulary_counts(spark, sf):
    targets = spark.createDataFrame([(t,) for t in ("ring", "widget", "promo", "siren", "red")], "label string")
    return op.label_vocabulary_counts(part_labels(spark, sf), label_set("labels"), targets)


@query(
    "crosstab",
    """SELECT event_type, count(*) FILTER (WHERE v = 'low') AS low, count(*) FILTER (WHERE v = 'mid') AS mid,
         count(*) FILTER (WHERE v = 'high') AS high
       FROM (SELECT event_type, CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END AS v
             FROM events) GROUP BY event_type""",
)
def crosstab(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_type",
        F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "mid").otherwise("high").alias("v"),
    )
    return op.crosstab(rows, "event_type", "v", ["low", "mid", "high"])


@query(
    "numeric_describe",
    """SELECT event_type, count(value) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) AS mean_cents,
         round(stddev_samp(value), 6) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25,
         quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max
       FROM events GROUP BY event_type""",
)
def numeric_describe(spark, sf):
    events = table(spark, sf, "events")
    moments = events.groupBy("event_type").agg(
        F.count("value").alias("n"),
        (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / F.count("value")).alias("mean_cents"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(events, ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "event_type")


@query(
    "manifest_status_rollup",
    f"""SELECT coalesce(project_class, 'ALL') AS project_class, status, count(*) AS n FROM (
          SELECT project_class, CASE WHEN duration < 0.5 THEN 'invalid' WHEN duration > 15 THEN 'warning' ELSE 'ok' END
            AS status FROM {DOCUMENTS_SQL}) GROUP BY GROUPING SETS ((project_class, status), (status))""",
)
def manifest_status_rollup(spark, sf):
    docs = documents(spark, sf).withColumn(
        "status",
        F.when(F.col("duration") < 0.5, "invalid").when(F.col("duration") > 15, "warning").otherwise("ok"),
    )
    return op.manifest_status_rollup(docs, "project_class", "status")
