"""Decision queries: events as detections of user sessions.

The SQL twin of the stateful ones is a row-by-row fold per session (a recursive CTE).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as op
from ..operators import policies as pol
from ..operators import service
from ..params import ACTION_NOTES, AUDIO_MODES, TAXONOMY
from ..streaming.windows import live_sliding_windows as sliding
from .fixtures import CLIPS_SQL, DETECTIONS_SQL, clips, detections, hash_split, hash_split_sql
from .registry import query, table

CLASSES = ("click", "error", "purchase", "signup")
ANC, PLAIN, SAFETY, STANDBY = AUDIO_MODES
DAY = 86400.0
ENTRIES = {
    "click": {"confidence_threshold": 0.2, "confirm_windows": 2},
    "error": {
        "target_mode": SAFETY,
        "confidence_threshold": 0.3,
        "high_priority": True,
        "critical": True,
        "quick_action_label": "Call emergency contact",
    },
    "purchase": {"target_mode": ANC, "confidence_threshold": 0.3},
}


def event_policies(spark):
    """click needs two windows and has no target, error is critical, signup is disabled, view is unknown."""
    base = {"confirm_windows": 1, "release_seconds": DAY, "cooldown_seconds": 2 * DAY}
    return pol.policy_table(spark, "Events", PLAIN, {n: {**base, **e} for n, e in ENTRIES.items()}, CLASSES)


POLICY_SQL = f"""(SELECT * FROM (VALUES
  ('click', TRUE, NULL, 0.2::DOUBLE, 2, 86400000000, 172800000000, FALSE, FALSE, NULL, TRUE),
  ('error', TRUE, '{SAFETY}', 0.3::DOUBLE, 1, 86400000000, 172800000000, TRUE, TRUE, 'Call emergency contact', TRUE),
  ('purchase', TRUE, '{ANC}', 0.3::DOUBLE, 1, 86400000000, 172800000000, FALSE, FALSE, NULL, TRUE),
  ('signup', FALSE, NULL, 0.8::DOUBLE, 3, 5000000, 5000000, FALSE, FALSE, NULL, TRUE))
  AS t(label, enabled, target, threshold, confirm, release_us, cooldown_us, high, critical, qa_label, notify))"""
GATE_SQL = f"""(SELECT d.*, p.* EXCLUDE (label), p.label IS NOT NULL AS known, coalesce(enabled, FALSE) AS trigger_enabled,
  coalesce(enabled AND confidence >= threshold, FALSE) AS cand,
  CASE WHEN p.label IS NULL THEN 'detected class ''' || d.label || ''' is not a supported trigger class - no action'
       WHEN NOT enabled THEN 'detected class ''' || d.label || ''' is not enabled in profile ''Events'' - no action'
       WHEN confidence < threshold THEN 'confidence ' || format('{{:.2f}}', confidence) || ' below threshold ' || format('{{:.2f}}', threshold)
         || ' for ''' || d.label || ''' - no action' END AS gate_reason, CAST(NULL AS VARCHAR) AS action
  FROM {DETECTIONS_SQL} d LEFT JOIN {POLICY_SQL} p ON p.label = d.label)"""
# User actions: a tenth of a second after every 7th event, confirm or reject, and some that are unknown.
ACTIONS_SQL = f"""(SELECT session_id, 1000000000 + seq AS seq, ts_us + 100000 AS ts_us, CASE WHEN seq % 5 = 0 THEN 'snooze' WHEN seq % 2 = 0 THEN 'confirm' ELSE 'reject' END AS action
  FROM {DETECTIONS_SQL} WHERE seq % 7 = 3)"""


def fold_sql(actions: bool) -> str:
    """All detections (and actions) with the state after each, folded row by row per session."""
    rows = f"SELECT * FROM {GATE_SQL}"
    if actions:
        rows += f" UNION ALL BY NAME SELECT * FROM {ACTIONS_SQL}"
    until = ", ".join(f"CASE WHEN fired AND label = '{c}' THEN ts_us + cooldown_us ELSE u_{c} END AS u_{c}" for c in CLASSES)
    zero = ", ".join(f"CAST(0 AS BIGINT) AS u_{c}" for c in CLASSES)
    own = "CASE label " + " ".join(f"WHEN '{c}' THEN u_{c}" for c in CLASSES) + " ELSE 0 END"
    state = "s_pend, s_run, s_act, s_rel, s_seen, s_mode, s_qa, s_qacls"
    carry = "ts_us, seq, label, confidence, trigger_enabled, cand, target, confirm, notify, high, critical, qa_label, gate_reason, action"
    return f"""(WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS rn FROM ({rows})),
    f AS (
      SELECT session_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS s_pend, CAST(0 AS BIGINT) AS s_run, CAST(NULL AS VARCHAR) AS s_act,
        CAST(0 AS BIGINT) AS s_rel, CAST(0 AS BIGINT) AS s_seen, '{PLAIN}' AS s_mode, CAST(NULL AS VARCHAR) AS s_qa, CAST(NULL AS VARCHAR) AS s_qacls, {zero},
        CAST(0 AS BIGINT) AS ts_us, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS label, 0.0::DOUBLE AS confidence, FALSE AS trigger_enabled, FALSE AS cand,
        CAST(NULL AS VARCHAR) AS target, 0 AS confirm, FALSE AS notify, FALSE AS high, FALSE AS critical, CAST(NULL AS VARCHAR) AS qa_label,
        CAST(NULL AS VARCHAR) AS gate_reason, CAST(NULL AS VARCHAR) AS action, FALSE AS verified, FALSE AS edge, FALSE AS fired, FALSE AS restored,
        CAST(NULL AS VARCHAR) AS gone, CAST(0 AS BIGINT) AS gone_rel, CAST(NULL AS VARCHAR) AS qa_before, CAST(NULL AS VARCHAR) AS qacls_before FROM (SELECT DISTINCT session_id FROM r)
      UNION ALL
      SELECT session_id, rn, pend, run, CASE WHEN restored THEN NULL ELSE act1 END, rel1, seen1,
        CASE WHEN restored THEN '{PLAIN}' WHEN verified AND target IS NOT NULL THEN target ELSE s_mode END,
        CASE WHEN restored OR (is_act AND action <> 'snooze') THEN NULL WHEN fired AND critical THEN qa_label ELSE s_qa END,
        CASE WHEN restored OR (is_act AND action <> 'snooze') THEN NULL WHEN fired AND critical THEN label ELSE s_qacls END, {until},
        {carry}, verified, edge, fired, restored, act1, rel1, s_qa, s_qacls
      FROM (SELECT *, CASE WHEN verified THEN label ELSE s_act END AS act1, CASE WHEN verified THEN ts_us ELSE s_seen END AS seen1,
              CASE WHEN verified THEN release_us ELSE s_rel END AS rel1,
              verified AND s_act IS DISTINCT FROM label AS edge, verified AND s_act IS DISTINCT FROM label AND ts_us >= {own} AS fired,
              NOT is_act AND NOT verified AND s_act IS NOT NULL AND pend IS DISTINCT FROM s_act AND ts_us - s_seen >= s_rel AS restored
            FROM (SELECT *, coalesce(NOT is_act AND cand AND run >= confirm, FALSE) AS verified FROM (
              SELECT r.*, {", ".join("f." + c.strip() for c in state.split(","))}, {", ".join(f"f.u_{c}" for c in CLASSES)}, r.action IS NOT NULL AS is_act,
                CASE WHEN r.action IS NOT NULL THEN f.s_pend WHEN r.cand THEN r.label END AS pend,
                CASE WHEN r.action IS NOT NULL THEN f.s_run WHEN r.cand THEN CASE WHEN f.s_pend = r.label THEN f.s_run + 1 ELSE 1 END ELSE 0 END AS run
              FROM f JOIN r ON r.session_id = f.session_id AND r.rn = f.rn + 1))))
    SELECT * FROM f WHERE rn > 0)"""


FOLD_SQL = fold_sql(actions=False)
CENTI = "(ts_us // 10000 + CASE WHEN ts_us % 10000 > 5000 OR (ts_us % 10000 = 5000 AND (ts_us // 10000) % 2 = 1) THEN 1 ELSE 0 END)"
STAMP = f"'t=' || ({CENTI} // 100) || '.' || lpad(CAST({CENTI} % 100 AS VARCHAR), 2, '0') || ' '"
STATE = "CASE WHEN verified THEN 'verified' WHEN restored THEN 'released' WHEN cand THEN 'pending' ELSE 'idle' END"
FOUND = "replace(label, '_', ' ') || ' detected'"
NOTE = f"CASE WHEN fired AND notify THEN {FOUND} || coalesce(' - ' || target || ' enabled', '') END"
WARN = f"CASE WHEN fired AND high THEN '[WARNING] ' || {FOUND} END"
QUICK = "CASE WHEN fired AND critical THEN qa_label END"
LINES = f"""list_transform(list_filter([CASE WHEN edge AND NOT fired THEN 'response suppressed by cooldown for ''' || label || '''' END,
  'notification: ' || {NOTE}, 'warning: ' || {WARN}, 'quick action presented (awaiting user confirmation): ' || {QUICK},
  CASE WHEN restored THEN 'trigger ''' || gone || ''' absent for ' || (gone_rel // 1000000) || '.0s - preferred mode restored' END,
  CASE WHEN {STATE} = 'pending' THEN 'awaiting persistence ' || s_run || '/' || confirm || ' for ''' || label || '''' END],
  lambda m: m IS NOT NULL), lambda m: {STAMP} || m)"""
REASONS = """list_filter([gate_reason, CASE WHEN edge AND NOT fired THEN 'response for ''' || label || ''' suppressed by cooldown (duplicate alert)' END],
  lambda m: m IS NOT NULL)"""
COOLING = "greatest(" + ", ".join(f"u_{c}" for c in CLASSES) + ") > ts_us"
DECISION_SQL = f"""SELECT session_id, seq, ts_us, label AS detected_class, confidence AS detected_confidence, trigger_enabled, {STATE} AS verification_state, verified,
  target AS policy_target_mode, s_mode AS audio_mode, '{PLAIN}' AS preferred_mode, {NOTE} AS notification, {WARN} AS warning, {QUICK} AS quick_action,
  s_qa IS NOT NULL AS quick_action_pending, s_act IS NOT NULL AND NOT verified AS release_timer_active,
  CASE WHEN s_act IS NOT NULL THEN greatest(0, s_rel - (ts_us - s_seen)) / 1000000.0::DOUBLE END AS release_remaining_seconds,
  {COOLING} AS cooldown_active, restored, array_to_string({REASONS}, ' | ') AS reasons, array_to_string({LINES}, ' | ') AS log"""


def decisions(spark, sf, actions=None):
    return op.decide(detections(spark, sf), event_policies(spark), CLASSES, actions=actions)


def joined(df):
    return df.withColumns({"reasons": F.array_join("reasons", " | "), "log": F.array_join("log", " | ")})


# --- policies ---------------------------------------------------------------------------

PART_POLICY = {
    "target_mode": f"CASE p_partkey % 4 WHEN 1 THEN '{PLAIN}' WHEN 2 THEN '{ANC}' WHEN 3 THEN 'Loud' END",
    "confirm_windows": "CAST(p_partkey % 4 AS INTEGER)",
    "release_seconds": "CAST(p_partkey % 11 - 1 AS DOUBLE)",
    "cooldown_seconds": "CAST(p_partkey % 13 - 1 AS DOUBLE)",
    "enabled": "p_partkey % 3 <> 0",
    "high_priority": "p_partkey % 5 = 0",
    "critical": "p_partkey % 7 = 0",
    "quick_action_label": "CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'Call' END",
}
PART_POLICY_SQL = ", ".join(f"{e} AS {n}" for n, e in PART_POLICY.items())
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD")


@query(
    "policy_validate",
    f"""SELECT p_partkey, array_to_string(list_filter([
          CASE WHEN class_name NOT IN {TYPES} THEN 'unknown_class' END, CASE WHEN target_mode = 'Loud' THEN 'unknown_target_mode' END,
          CASE WHEN NOT (t > 0 AND t <= 1) THEN 'threshold_not_in_0_1' END, CASE WHEN confirm_windows < 1 THEN 'confirm_windows_below_1' END,
          CASE WHEN release_seconds < 0 THEN 'negative_release' END, CASE WHEN cooldown_seconds < 0 THEN 'negative_cooldown' END,
          CASE WHEN (high_priority OR critical) AND NOT enabled THEN 'priority_of_disabled_entry' END,
          CASE WHEN critical AND trim(coalesce(quick_action_label, '')) = '' THEN 'critical_without_action' END,
          CASE WHEN coalesce(quick_action_label, '') <> '' AND NOT critical THEN 'action_without_critical' END], lambda x: x IS NOT NULL), ',') AS problems
        FROM (SELECT p_partkey, p_type AS class_name, (p_size - 1) / 45.0::DOUBLE AS t, {PART_POLICY_SQL} FROM part)""",
)
def policy_validate(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_type AS class_name", "(p_size - 1) / 45.0D AS confidence_threshold",
        *[f"{e} AS {n}" for n, e in PART_POLICY.items()],
    )
    return rows.select("p_partkey", F.array_join(pol.policy_problems(TYPES), ",").alias("problems"))


PAYLOAD = f"""CASE c_custkey % 37 WHEN 10 THEN '[1]' WHEN 11 THEN 'not json' WHEN 12 THEN '{{"policies": null}}' WHEN 13 THEN '{{}}' ELSE concat(
  '{{"profile_name": ', CASE c_custkey % 17 WHEN 3 THEN '7' WHEN 5 THEN 'null' WHEN 7 THEN '""' ELSE concat('"', c_mktsegment, '"') END,
  ', "preferred_mode": ', CASE c_custkey % 13 WHEN 2 THEN 'null' WHEN 4 THEN '3' WHEN 6 THEN '"Loud"' WHEN 8 THEN '"  "' ELSE '"{PLAIN}"' END,
  ', "policies": {{"Alarm": ', CASE c_custkey % 7 WHEN 1 THEN 'null' WHEN 2 THEN '8' ELSE '{{}}' END, ', "', CASE c_custkey % 11 WHEN 5 THEN 'Cat' ELSE 'Siren' END,
  '": {{"enabled": ', CASE c_custkey % 19 WHEN 4 THEN '1' ELSE 'true' END, ', "confidence_threshold": ', CASE c_custkey % 23 WHEN 6 THEN '"high"' WHEN 0 THEN '0'
    ELSE concat('0.', CAST(c_custkey % 9 + 1 AS VARCHAR(2))) END, ', "confirm_windows": ', CASE c_custkey % 29 WHEN 7 THEN '1.5' WHEN 8 THEN '0' ELSE '2' END,
  CASE c_custkey % 31 WHEN 9 THEN ', "colour": 1' ELSE '' END, '}}}}}}') END"""


@query(
    "policy_payload_parse",
    f"""WITH p AS (SELECT c_custkey, CASE WHEN json_valid(js) THEN CAST(js AS JSON) END AS j FROM (SELECT c_custkey, {PAYLOAD} AS js FROM customer)),
        o AS (SELECT c_custkey, j, json_type(j) AS t, json_type(j, '$.profile_name') AS pn, json_type(j, '$.preferred_mode') AS pm, j->>'$.preferred_mode' AS mode,
                json_type(j, '$.policies') AS ps FROM p),
        e AS (SELECT c_custkey, j, unnest(json_keys(j, '$.policies')) AS cls FROM o WHERE t = 'OBJECT' AND ps = 'OBJECT'),
        k AS (SELECT c_custkey, cls, json_extract(j, '$.policies.' || cls) AS v FROM e),
        v AS (SELECT c_custkey, cls, v, unnest(json_keys(v)) AS f FROM k WHERE json_type(v) = 'OBJECT'),
        r AS (
          SELECT c_custkey, 'payload is not an object' AS problem FROM o WHERE t IS NULL OR t <> 'OBJECT'
          UNION ALL SELECT c_custkey, 'profile_name must be text' FROM o WHERE t = 'OBJECT' AND pn NOT IN ('VARCHAR', 'NULL')
          UNION ALL SELECT c_custkey, 'preferred_mode must be text or null' FROM o WHERE t = 'OBJECT' AND pm NOT IN ('VARCHAR', 'NULL')
          UNION ALL SELECT c_custkey, 'unknown preferred_mode' FROM o WHERE t = 'OBJECT' AND pm = 'VARCHAR' AND trim(mode) <> '' AND trim(mode) NOT IN {AUDIO_MODES}
          UNION ALL SELECT c_custkey, 'policies must be an object' FROM o WHERE t = 'OBJECT' AND ps <> 'OBJECT'
          UNION ALL SELECT c_custkey, 'unknown class ' || cls FROM k WHERE cls NOT IN ('Siren', 'Alarm')
          UNION ALL SELECT c_custkey, cls || ': policy must be an object' FROM k WHERE cls IN ('Siren', 'Alarm') AND json_type(v) NOT IN ('OBJECT', 'NULL')
          UNION ALL SELECT c_custkey, cls || ': unknown field ' || f FROM v WHERE f NOT IN ('enabled', 'confidence_threshold', 'confirm_windows')
          UNION ALL SELECT c_custkey, cls || ': wrong type of ' || f FROM v WHERE (f = 'enabled' AND json_type(v, '$.enabled') <> 'BOOLEAN')
             OR (f = 'confidence_threshold' AND json_type(v, '$.confidence_threshold') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
             OR (f = 'confirm_windows' AND json_type(v, '$.confirm_windows') NOT IN ('UBIGINT', 'BIGINT'))
          UNION ALL SELECT c_custkey, cls || ': threshold_not_in_0_1' FROM k WHERE cls = 'Siren' AND json_type(v, '$.confidence_threshold') = 'UBIGINT'
          UNION ALL SELECT c_custkey, cls || ': confirm_windows_below_1' FROM k WHERE cls = 'Siren' AND v->>'$.confirm_windows' = '0'),
        a AS (SELECT o.*, s.cls, CASE WHEN ps = 'OBJECT' THEN json_extract(j, '$.policies.' || s.cls) END AS v FROM o, (SELECT unnest({list(TAXONOMY)}) AS cls) AS s
              WHERE c_custkey NOT IN (SELECT c_custkey FROM r))
        SELECT c_custkey, 'problem' AS kind, problem AS item, NULL AS detail FROM r
        UNION ALL SELECT c_custkey, 'policy', cls, concat_ws('|', coalesce(nullif(j->>'$.profile_name', ''), 'Custom'), nullif(trim(mode), ''),
          coalesce(v->>'$.enabled', 'false'), coalesce(v->>'$.confidence_threshold', '0.8'), coalesce(v->>'$.confirm_windows', '3'), '5.0', '5.0', 'false', 'false', 'true') FROM a""",
)
def policy_payload_parse(spark, sf):
    payloads = table(spark, sf, "customer").select("c_custkey", F.expr(PAYLOAD).alias("payload"))
    judged = pol.judge_payloads(payloads, "c_custkey", "payload")
    fields = ("profile_name", "preferred_mode", *op.POLICY_COLUMNS)

    def row(kind, item, detail):
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), detail.alias("detail"))

    problems = F.transform("problems", lambda p: row("problem", p, F.lit(None).cast("string")))
    policies = F.transform(
        "policies", lambda p: row("policy", p["class_name"], F.concat_ws("|", *[p[f].cast("string") for f in fields]))
    )
    return judged.select("c_custkey", F.explode(F.concat(problems, F.coalesce(policies, F.array()))).alias("r")).select("c_custkey", "r.*")


BRAND_MODES_SQL = f"""(SELECT p_brand AS profile_name, max(CASE WHEN p_size > 48 THEN '{PLAIN}' END) AS preferred_mode, p_type AS class_name,
  CASE WHEN max(p_size) % 2 = 0 THEN '{ANC}' END AS target_mode FROM part GROUP BY p_brand, p_type)"""
ALL_TYPES = tuple(sorted((*TYPES, "SMALL")))


@query(
    "profile_build",
    f"""WITH m AS {BRAND_MODES_SQL}, b AS (SELECT profile_name, max(preferred_mode) AS preferred_mode FROM m GROUP BY profile_name),
        l AS (SELECT profile_name, string_agg(class_name, ',' ORDER BY class_name) AS enabled_classes FROM m GROUP BY profile_name)
        SELECT b.profile_name, b.preferred_mode, t.class_name, m.class_name IS NOT NULL AS enabled, m.target_mode, 0.8::DOUBLE AS confidence_threshold,
          CASE WHEN m.class_name IS NULL THEN 3 ELSE 2 END AS confirm_windows, 5.0::DOUBLE AS release_seconds,
          CASE WHEN m.class_name IS NULL THEN 5.0::DOUBLE ELSE 9.0::DOUBLE END AS cooldown_seconds, FALSE AS high_priority, FALSE AS critical,
          CAST(NULL AS VARCHAR) AS quick_action_label, TRUE AS notify, l.enabled_classes
        FROM b CROSS JOIN (SELECT unnest({list(ALL_TYPES)}) AS class_name) t JOIN l USING (profile_name)
        LEFT JOIN m ON m.profile_name = b.profile_name AND m.class_name = t.class_name""",
)
def profile_build(spark, sf):
    modes = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("profile_name"), F.col("p_type").alias("class_name"))
        .agg(
            F.max(F.when(F.col("p_size") > 48, PLAIN)).alias("preferred_mode"),
            F.when(F.max("p_size") % 2 == 0, ANC).alias("target_mode"),
        )
    )
    rows = pol.build_profiles(modes, ALL_TYPES, {"confirm_windows": 2, "cooldown_seconds": 9.0})
    listed = pol.enabled_list(rows, ALL_TYPES).withColumn("enabled_classes", F.array_join("enabled_classes", ","))
    return rows.join(listed, "profile_name")


# --- gate, streak, verification ---------------------------------------------------------


@query("policy_gate", f"SELECT session_id, seq, trigger_enabled, cand AS candidate, gate_reason AS reason FROM {GATE_SQL}")
def policy_gate(spark, sf):
    rows = op.gate(op.attach_policy(detections(spark, sf), event_policies(spark)), CLASSES)
    return rows.select("session_id", "seq", "trigger_enabled", "candidate", op.gate_reason(CLASSES).alias("reason"))


def scanned(spark, sf, stage):
    """Detections after the gate and the given stages of the scan."""
    gated = op.gate(op.attach_policy(detections(spark, sf), event_policies(spark)), CLASSES)
    return op.per_key(gated, ["session_id"], op.ORDER, lambda rows: stage(op.persistence(rows)).result())


@query(
    "persistence_streak",
    f"""SELECT session_id, seq, CASE WHEN cand THEN row_number() OVER (PARTITION BY session_id, g, cand ORDER BY ts_us, seq) ELSE 0 END AS streak FROM (
          SELECT *, sum(CASE WHEN cand AND prev IS NOT DISTINCT FROM label THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS g FROM (
            SELECT *, lag(CASE WHEN cand THEN label END) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS prev FROM {GATE_SQL}))""",
)
def persistence_streak(spark, sf):
    return scanned(spark, sf, lambda rows: rows).select("session_id", "seq", "streak")


@query("trigger_verify", f"SELECT session_id, seq, verified, edge AS fire_edge, s_act AS active_class FROM {FOLD_SQL}")
def trigger_verify(spark, sf):
    return scanned(spark, sf, op.verification).select("session_id", "seq", "verified", "fire_edge", "active_class")


@query("cooldown_suppress", f"SELECT session_id, seq, label, fired FROM {FOLD_SQL} WHERE edge")
def cooldown_suppress(spark, sf):
    edges = scanned(spark, sf, op.verification).filter("fire_edge")
    cold, hot = op.split_hot(edges, ["session_id"])
    out = None
    for rows, chunked in ((cold, False), (hot, True)):
        if rows is not None:
            rows = rows.withColumn("_cooldown", op.micros("cooldown_seconds"))
            fires = op.cooldown_fires(rows, ["session_id"], chunked).withColumn("fired", F.lit(True))
            part = rows.join(fires, ["session_id", "n"], "left").select(
                "session_id", "seq", "label", F.coalesce("fired", F.lit(False)).alias("fired")
            )
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "response_text",
    f"""SELECT p_partkey, replace(replace(p_name, ' ', '_'), '_', ' ') || ' detected' || coalesce(' - ' || target_mode || ' enabled', '') AS notification,
          '[WARNING] ' || p_name || ' detected' AS warning FROM (SELECT p_partkey, p_name, {PART_POLICY['target_mode']} AS target_mode FROM part)""",
)
def response_text(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("label"),
        F.expr(PART_POLICY["target_mode"]).alias("target_mode"),
    )
    text = op.response_text("label", "target_mode")
    return rows.select("p_partkey", *[c.alias(n) for n, c in text.items()])


@query("release_restore", f"SELECT session_id, seq, gone AS released_class, s_mode AS audio_mode FROM {FOLD_SQL} WHERE restored")
def release_restore(spark, sf):
    rows = scanned(spark, sf, lambda r: op.audio_mode(op.verification(r)))
    return rows.filter("restored").select("session_id", "seq", F.col("_last.label").alias("released_class"), "audio_mode")


@query("verification_state", f"SELECT session_id, seq, {STATE} AS verification_state FROM {FOLD_SQL}")
def verification_state(spark, sf):
    rows = scanned(spark, sf, op.verification)
    return rows.select("session_id", "seq", op.verification_state().alias("verification_state"))


# --- full decisions ---------------------------------------------------------------------


@query(
    "quick_action_events",
    f"""SELECT session_id, seq, ts_us, action, CASE WHEN qa_before IS NOT NULL AND action <> 'snooze' THEN qacls_before END AS class_name,
          CASE WHEN action <> 'snooze' THEN qa_before END AS quick_action_label,
          CASE WHEN qa_before IS NOT NULL AND action <> 'snooze' THEN action = 'confirm' END AS confirmed, FALSE AS executed,
          CASE WHEN qa_before IS NOT NULL AND action <> 'snooze' THEN CASE action WHEN 'confirm' THEN '{ACTION_NOTES["confirm"]}' ELSE '{ACTION_NOTES["reject"]}' END END AS note,
          CASE WHEN qa_before IS NOT NULL AND action <> 'snooze' THEN {STAMP} || CASE action WHEN 'confirm' THEN 'quick action confirmed by user for ''' || qacls_before || ''': ' || qa_before
             || ' (presentation-only; the supervisor executed nothing)' ELSE 'quick action dismissed by user for ''' || qacls_before || ''': ' || qa_before END END AS log,
          CASE WHEN action = 'snooze' THEN 'action must be ''confirm'' or ''reject''' WHEN qa_before IS NULL THEN 'no user-confirmed quick action is currently pending' END AS error
        FROM {fold_sql(actions=True)} WHERE action IS NOT NULL""",
)
def quick_action_events(spark, sf):
    det = detections(spark, sf)
    actions = det.filter("seq % 7 = 3").select(
        "session_id",
        (F.col("seq") + 1000000000).alias("seq"),
        (F.col("ts_us") + 100000).alias("ts_us"),
        F.when(F.col("seq") % 5 == 0, "snooze").when(F.col("seq") % 2 == 0, "confirm").otherwise("reject").alias("action"),
    )
    return op.quick_action_results(det, event_policies(spark), CLASSES, actions)


@query("decision_stream", f"{DECISION_SQL} FROM {FOLD_SQL}")
def decision_stream(spark, sf):
    return joined(decisions(spark, sf))


@query(
    "decision_log",
    f"SELECT session_id, seq, ts_us, CAST(i - 1 AS INTEGER) AS line, ls[i] AS message FROM (SELECT session_id, seq, ts_us, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, {LINES} AS ls FROM {FOLD_SQL}))",
)
def decision_log(spark, sf):
    return op.decision_log(decisions(spark, sf))


@query("session_snapshot", f"SELECT * FROM ({DECISION_SQL} FROM {FOLD_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, seq DESC) = 1")
def session_snapshot(spark, sf):
    return joined(op.session_snapshot(decisions(spark, sf)))


STEPS = {
    "kind": "CASE WHEN role = 'assistant' THEN 'prediction' ELSE 'step' END",
    "advance_us": "CASE WHEN length(text) % 11 = 3 THEN CAST(-1 AS BIGINT) ELSE CAST(length(text) % 1000 * 1000 AS BIGINT) END",
    "label_given": "turn % 3 = 0",
    "label": "CASE WHEN role = 'assistant' OR length(text) % 4 <> 1 THEN concat('L', CAST(length(text) % 5 AS VARCHAR(2))) END",
    "confidence": "CASE WHEN length(text) % 7 <> 2 THEN CAST(length(text) % 10 AS DOUBLE) / 10 END",
}
STEPS_SQL = "(SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in STEPS.items()) + " FROM conversations)"


@query(
    "virtual_clock",
    f"""WITH s AS (SELECT *, max(CASE WHEN kind = 'prediction' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM {STEPS_SQL}),
        j AS (SELECT s.*, p.label AS ll, p.confidence AS lc, CASE WHEN s.kind <> 'prediction' THEN CASE WHEN s.advance_us < 0 THEN 'advance_seconds must be >= 0'
                WHEN NOT s.label_given AND p.label IS NULL THEN 'no detection yet - analyze a clip first' END END AS error
              FROM s LEFT JOIN {STEPS_SQL} p ON p.conv_id = s.conv_id AND p.turn = s.lt),
        c AS (SELECT *, CAST(sum(CASE WHEN kind <> 'prediction' AND error IS NULL THEN advance_us ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS now_us FROM j)
        SELECT conv_id, turn, now_us, CASE WHEN error IS NULL THEN CASE WHEN label_given THEN label ELSE ll END END AS detected,
          CASE WHEN error IS NULL THEN CASE WHEN NOT label_given THEN coalesce(lc, 0) WHEN label IS NULL THEN 0 ELSE coalesce(confidence, nullif(lc, 0), 1) END END AS detected_confidence, error
        FROM c WHERE kind = 'step'""",
)
def virtual_clock(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", *[f"{e} AS {n}" for n, e in STEPS.items()])
    return op.virtual_clock(rows, ["conv_id"], ["turn"])


@query(
    "session_reset",
    f"""SELECT session_id, seq, CAST(sum(CASE WHEN label = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS BIGINT) AS epoch FROM {DETECTIONS_SQL}""",
)
def session_reset(spark, sf):
    rows = op.session_epochs(detections(spark, sf), ["session_id"], op.ORDER, F.col("label") == "signup")
    return rows.select("session_id", "seq", "epoch")


# --- service data -----------------------------------------------------------------------

CATALOG_CLASSES = ("3-MEDIUM", "1-URGENT", "5-LOW")


@query(
    "catalog_allowlist",
    f"""SELECT clip_id, project_class, list_position({list(CATALOG_CLASSES)}, project_class) - 1 AS class_position FROM {CLIPS_SQL}
        WHERE {hash_split_sql('clip_id')} = 'val' AND cents >= 5000000 AND project_class IN {CATALOG_CLASSES}
        QUALIFY row_number() OVER (PARTITION BY project_class ORDER BY clip_id) <= 3""",
)
def catalog_allowlist(spark, sf):
    rows = clips(spark, sf)
    splits = rows.select("clip_id", hash_split("clip_id").alias("split"))
    ledger = rows.select("clip_id", "project_class", F.when(F.col("cents") >= 5000000, "kept").otherwise("excluded").alias("status"))
    out = service.catalog_allowlist(splits, ledger, "clip_id", "project_class", CATALOG_CLASSES, 3)
    return out.select("clip_id", "project_class", "class_position")


TEXT_P = "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'n/a' ELSE concat(' ', CAST(n_chars AS VARCHAR(10)), '.5') END"
TEXT_D = "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR(10)) END"


@query(
    "duration_fallback",
    f"SELECT doc_id, coalesce(TRY_CAST(trim({TEXT_P}) AS DOUBLE), TRY_CAST(trim({TEXT_D}) AS DOUBLE)) AS duration FROM documents",
)
def duration_fallback(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{TEXT_P} AS processed", f"{TEXT_D} AS raw")
    return rows.select("doc_id", service.duration_fallback("processed", "raw").alias("duration"))


@query(
    "payload_screen",
    """SELECT page_id, CASE WHEN data IS NULL OR data = '' THEN 'data is required'
         WHEN NOT ok THEN 'invalid base64 data' WHEN octet_length(b) > 4000 THEN 'file too large (limit 4000 bytes)'
         WHEN octet_length(b) < 12 THEN 'invalid WAV file: too short' WHEN substr(hex(b), 1, 8) <> '52494646' THEN 'invalid WAV file: missing RIFF header'
         WHEN substr(hex(b), 17, 8) <> '57415645' THEN 'invalid WAV file: missing WAVE signature' WHEN seconds > 5 THEN 'file too long (limit 5s)' END AS reason
       FROM (SELECT page_id, data, ok, seconds, CASE WHEN ok THEN from_base64(data) END AS b FROM (
         SELECT *, length(data) % 4 = 0 AND regexp_full_match(data, '[A-Za-z0-9+/]*={0,2}') AS ok FROM (
           SELECT page_id, length(html) / 500.0::DOUBLE AS seconds, CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '***=' WHEN 2 THEN to_base64(encode('short'))
             WHEN 3 THEN to_base64(encode(html)) WHEN 4 THEN to_base64(encode('RIFF0000XXXX' || html))
             WHEN 5 THEN substr(to_base64(encode('RIFF0000WAVE' || html)), 2) ELSE to_base64(encode('RIFF0000WAVE' || html)) END AS data FROM pages)))""",
)
def payload_screen(spark, sf):
    html = F.col("html")

    def encoded(text):
        return F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit(""))

    wav = encoded(F.concat(F.lit("RIFF0000WAVE"), html))
    kind = F.col("page_id") % 9
    rows = table(spark, sf, "pages").select(
        "page_id",
        (F.length(html) / 500.0).alias("seconds"),
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "***=")
        .when(kind == 2, encoded(F.lit("short")))
        .when(kind == 3, encoded(html))
        .when(kind == 4, encoded(F.concat(F.lit("RIFF0000XXXX"), html)))
        .when(kind == 5, wav.substr(F.lit(2), F.length(wav)))
        .otherwise(wav)
        .alias("data"),
    )
    return rows.select("page_id", service.payload_screen("data", "seconds", 4000, 5).alias("reason"))


RESPONSES = (("ECONOMY", "Alert Mode"), ("LARGE", "Max ANC Mode"), ("PROMO", "Alert Mode"), ("TINY", "Alert Mode"))


@query(
    "response_coverage",
    f"""WITH m AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RESPONSES)}) AS t(class_name, response))
        SELECT p_partkey AS id, p_type AS class_name, coalesce(response, 'missing') AS result FROM part LEFT JOIN m ON m.class_name = p_type
        UNION ALL SELECT -1, class_name, 'unknown' FROM m WHERE class_name NOT IN (SELECT p_type FROM part)""",
)
def response_coverage(spark, sf):
    responses = spark.createDataFrame(list(RESPONSES), "class_name string, response string")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class_name"))
    gaps = service.response_coverage(responses, parts.select("class_name").distinct())
    found = service.attach_response(parts, responses, "class_name")
    missing = gaps.filter("problem = 'missing'").select("class_name", F.col("problem"))
    rows = found.join(missing, "class_name", "left").select(
        "id", "class_name", F.coalesce("response", "problem").alias("result")
    )
    extra = gaps.filter("problem = 'unknown'").select(
        F.lit(-1).cast("bigint").alias("id"), "class_name", F.col("problem").alias("result")
    )
    return rows.unionByName(extra)


@query(
    "live_sliding_windows",
    """SELECT (epoch_us(ts) // 100000 - k) * 100000 AS start_us, (epoch_us(ts) // 100000 - k) * 100000 + 200000 AS end_us, event_type, count(*) AS n,
         max(value) AS max_confidence FROM events, (VALUES (0), (1)) AS t(k) GROUP BY ALL""",
)
def live_sliding_windows(spark, sf):
    return sliding(table(spark, sf, "events"), "ts", "event_type", "value")
