"""Session queries beyond single detections: silence, profiles applied in mid-session, live windows, state snapshots.

The SQL twin is a row-by-row fold per session (a recursive CTE) that knows silences and profiles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as op
from ..operators import policies as pol
from ..session import ensure_checkpoint_dir
from ..sources.sinks import scratch_path
from ..streaming import decisions as streaming
from ..streaming.windows import window_detections
from . import decisions as D
from .fixtures import DETECTIONS_SQL, detections
from .registry import query, table

HOUR_US = 3_600_000_000
SILENCE_US = 12 * HOUR_US
#: The time up to which the sessions are known: ten days after the last event, so that some end in silence.
UNTIL_SQL = "(SELECT CAST(max(epoch_us(ts)) AS BIGINT) FROM events)"

QUIET = {
    "click": {"confidence_threshold": 0.4, "confirm_windows": 1, "target_mode": D.SAFETY, "high_priority": True},
    "view": {"confidence_threshold": 0.1, "confirm_windows": 2, "notify": False},
}
QUIET_CLASSES = ("click", "error", "purchase", "signup", "view")


def all_policies(spark):
    """The events' profile, and one that hears clicks at once and views in pairs, under another preferred mode."""
    base = {"confirm_windows": 1, "release_seconds": D.DAY / 4, "cooldown_seconds": D.DAY / 2}
    quiet = pol.policy_table(spark, "Quiet", D.ANC, {n: {**base, **e} for n, e in QUIET.items()}, QUIET_CLASSES)
    return D.event_policies(spark).unionByName(quiet)


ALL_POLICY_SQL = f"""(SELECT 'Events' AS profile, '{D.PLAIN}' AS preferred, * FROM {D.POLICY_SQL} UNION ALL SELECT * FROM (VALUES
  ('Quiet', '{D.ANC}', 'click', TRUE, '{D.SAFETY}', 0.4::DOUBLE, 1, 21600000000, 43200000000, TRUE, FALSE, NULL, TRUE),
  ('Quiet', '{D.ANC}', 'error', FALSE, NULL, 0.8::DOUBLE, 3, 5000000, 5000000, FALSE, FALSE, NULL, TRUE),
  ('Quiet', '{D.ANC}', 'purchase', FALSE, NULL, 0.8::DOUBLE, 3, 5000000, 5000000, FALSE, FALSE, NULL, TRUE),
  ('Quiet', '{D.ANC}', 'signup', FALSE, NULL, 0.8::DOUBLE, 3, 5000000, 5000000, FALSE, FALSE, NULL, TRUE),
  ('Quiet', '{D.ANC}', 'view', TRUE, NULL, 0.1::DOUBLE, 2, 21600000000, 43200000000, FALSE, FALSE, NULL, FALSE))
  AS t(profile, preferred, label, enabled, target, threshold, confirm, release_us, cooldown_us, high, critical, qa_label, notify))"""
SHOWN = "coalesce('''' || d.label || '''', 'None')"


def gated_sql(rows: str, known) -> str:
    """Detections (session, epoch, profile, epoch_end, seq, ts_us, label, confidence) under their profile's policy."""
    return f"""(SELECT d.*, p.* EXCLUDE (label, profile, preferred), m.preferred, coalesce(enabled, FALSE) AS trigger_enabled,
      coalesce(enabled AND confidence >= threshold, FALSE) AND coalesce(d.label IN {tuple(known)}, FALSE) AS cand,
      CASE WHEN d.label IS NULL OR d.label NOT IN {tuple(known)} THEN 'detected class ' || {SHOWN} || ' is not a supported trigger class - no action'
           WHEN NOT coalesce(enabled, FALSE) THEN 'detected class ' || {SHOWN} || ' is not enabled in profile ''' || d.profile || ''' - no action'
           WHEN confidence < threshold THEN 'confidence ' || format('{{:.2f}}', confidence) || ' below threshold ' || format('{{:.2f}}', threshold)
             || ' for ' || {SHOWN} || ' - no action' END AS gate_reason
      FROM {rows} d JOIN (SELECT DISTINCT profile, preferred FROM {ALL_POLICY_SQL}) m ON m.profile = d.profile
      LEFT JOIN {ALL_POLICY_SQL} p ON p.label = d.label AND p.profile = d.profile)"""


def fold_sql(gated: str, silence: int | None, until: str = "0") -> str:
    """All rows with the state after each, and a row for each release that falls into a silence."""
    names = QUIET_CLASSES
    known = f"least(coalesce(epoch_end, {until}), {until})"
    wait = f"ts_us + {silence or 0}"
    old = ", ".join(f"f.u_{c}" for c in names)
    until_u = ", ".join(f"CASE WHEN fired AND label = '{c}' THEN ts_us + cooldown_us ELSE u_{c} END AS u_{c}" for c in names)
    own = "CASE label " + " ".join(f"WHEN '{c}' THEN u_{c}" for c in names) + " ELSE 0 END"
    zero = ", ".join(f"CAST(0 AS BIGINT) AS u_{c}" for c in names)
    carry = "ts_us, seq, label, confidence, trigger_enabled, cand, target, confirm, notify, high, critical, qa_label, gate_reason, preferred, epoch_end"
    quiet = f"f.s_act IS NOT NULL AND greatest(f.s_seen + f.s_rel, f.{wait}) < r.ts_us" if silence else "FALSE"
    gap = f"r.ts_us - f.ts_us > {silence} AND f.rn > 0" if silence else "FALSE"
    text, big = "CAST(NULL AS VARCHAR)", "CAST(0 AS BIGINT)"
    silent = f"""SELECT session, epoch, profile, moment AS ts_us, CAST(NULL AS BIGINT) AS seq, {text} AS label, 0.0::DOUBLE AS confidence, FALSE AS trigger_enabled,
        FALSE AS cand, {text} AS target, 0 AS confirm, FALSE AS notify, FALSE AS high, FALSE AS critical, {text} AS qa_label,
        'detected class None is not a supported trigger class - no action' AS gate_reason, preferred, FALSE AS verified, FALSE AS edge, FALSE AS fired, TRUE AS restored,
        cls AS gone, rel AS gone_rel, {text} AS s_act, {big} AS s_rel, {big} AS s_seen, preferred AS s_mode, {text} AS s_qa, {big} AS s_run,
        cooling, TRUE AS silent FROM"""
    cooling = "greatest(" + ", ".join(f"u_{c}" for c in names) + ")"
    return f"""(WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY session, epoch ORDER BY ts_us, seq) AS rn FROM {gated}),
    f AS (
      SELECT session, epoch, profile, {big} AS rn, {text} AS s_pend, {big} AS s_run, {text} AS s_act, {big} AS s_rel, {big} AS s_seen, {text} AS s_mode, {text} AS s_qa,
        {zero}, {big} AS ts_us, {big} AS seq, {text} AS label, 0.0::DOUBLE AS confidence, FALSE AS trigger_enabled, FALSE AS cand, {text} AS target, 0 AS confirm,
        FALSE AS notify, FALSE AS high, FALSE AS critical, {text} AS qa_label, {text} AS gate_reason, {text} AS preferred, {big} AS epoch_end,
        FALSE AS verified, FALSE AS edge, FALSE AS fired, FALSE AS restored, {text} AS gone, {big} AS gone_rel,
        {big} AS quiet_at, {text} AS quiet_cls, {big} AS quiet_rel, {big} AS cooling_before FROM (SELECT DISTINCT session, epoch, profile FROM r)
      UNION ALL
      SELECT session, epoch, profile, rn, pend, run, CASE WHEN restored THEN NULL ELSE act1 END, rel1, seen1,
        CASE WHEN restored THEN preferred WHEN verified AND target IS NOT NULL THEN target ELSE coalesce(s_mode, preferred) END,
        CASE WHEN restored THEN NULL WHEN fired AND critical THEN qa_label ELSE s_qa END, {until_u},
        {carry}, verified, edge, fired, restored, act1, rel1, quiet_at, quiet_cls, quiet_rel, cooling_before
      FROM (SELECT *, CASE WHEN verified THEN label ELSE s_act END AS act1, CASE WHEN verified THEN ts_us ELSE s_seen END AS seen1,
              CASE WHEN verified THEN release_us ELSE s_rel END AS rel1,
              verified AND s_act IS DISTINCT FROM label AS edge, verified AND s_act IS DISTINCT FROM label AND ts_us >= {own} AS fired,
              NOT verified AND s_act IS NOT NULL AND pend IS DISTINCT FROM s_act AND ts_us - s_seen >= s_rel AS restored
            FROM (SELECT *, coalesce(cand AND run >= confirm, FALSE) AS verified FROM (
              SELECT *, CASE WHEN cand THEN label END AS pend, CASE WHEN cand THEN CASE WHEN s_pend = label THEN s_run + 1 ELSE 1 END ELSE 0 END AS run FROM (
                SELECT r.*, {old}, CASE WHEN {gap} THEN NULL ELSE f.s_pend END AS s_pend, f.s_run, CASE WHEN {quiet} THEN NULL ELSE f.s_act END AS s_act, f.s_rel, f.s_seen,
                  CASE WHEN {quiet} THEN NULL ELSE f.s_mode END AS s_mode, CASE WHEN {quiet} THEN NULL ELSE f.s_qa END AS s_qa,
                  CASE WHEN {quiet} THEN greatest(f.s_seen + f.s_rel, f.{wait}) END AS quiet_at, f.s_act AS quiet_cls, f.s_rel AS quiet_rel,
                  greatest({old}) AS cooling_before
                FROM f JOIN r ON r.session IS NOT DISTINCT FROM f.session AND r.epoch = f.epoch AND r.rn = f.rn + 1)))))
    SELECT session, epoch, profile, ts_us, seq, label, confidence, trigger_enabled, cand, target, confirm, notify, high, critical, qa_label, gate_reason, preferred,
      verified, edge, fired, restored, gone, gone_rel, s_act, s_rel, s_seen, s_mode, s_qa, s_run, {cooling} AS cooling, FALSE AS silent FROM f WHERE rn > 0
    UNION ALL {silent} (SELECT *, quiet_at AS moment, quiet_cls AS cls, quiet_rel AS rel, cooling_before AS cooling FROM f WHERE quiet_at IS NOT NULL AND rn > 0)
    UNION ALL {silent} (SELECT *, greatest(s_seen + s_rel, {wait}) AS moment, s_act AS cls, s_rel AS rel, {cooling} AS cooling
      FROM f WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY session, epoch ORDER BY rn DESC) = 1) WHERE cls IS NOT NULL AND {f"moment < {known}" if silence else "FALSE"})"""


# The pieces of a decision are those of the plain fold; cooldowns and the preferred mode come from the row.
DECISION_SQL = D.DECISION_SQL.replace(D.COOLING, "cooling > ts_us").replace(f"'{D.PLAIN}' AS preferred_mode", "preferred AS preferred_mode")
DECISION_SQL = DECISION_SQL.replace("SELECT session_id,", "SELECT session AS session_id,")

PLAIN_ROWS_SQL = f"(SELECT session_id AS session, 0 AS epoch, 'Events' AS profile, CAST(NULL AS BIGINT) AS epoch_end, * EXCLUDE (session_id) FROM {DETECTIONS_SQL})"
SILENT_FOLD_SQL = fold_sql(gated_sql(PLAIN_ROWS_SQL, D.CLASSES), SILENCE_US, UNTIL_SQL)


def last_event(spark, sf) -> int:
    return detections(spark, sf).agg(F.max("ts_us")).first()[0]


@query("release_in_silence", f"{DECISION_SQL}, silent FROM {SILENT_FOLD_SQL}")
def release_in_silence(spark, sf):
    """Decisions where half a day without an event is a silence; releases by silence are rows of their own."""
    det = detections(spark, sf)
    return D.joined(op.decide(det, D.event_policies(spark), D.CLASSES, silence_us=SILENCE_US, until=last_event(spark, sf)))


def profile_changes(spark, sf):
    """Sign-ups apply a profile, by turns the quiet one and the events' own."""
    return detections(spark, sf).filter("label = 'signup'").select(
        "session_id", "ts_us", "seq", F.when(F.col("seq") % 2 == 0, "Quiet").otherwise("Events").alias("profile_name")
    )


CHANGES_SQL = f"""(SELECT session_id, ts_us, seq, CASE WHEN seq % 2 = 0 THEN 'Quiet' ELSE 'Events' END AS profile,
  row_number() OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS epoch, lead(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS epoch_end
  FROM {DETECTIONS_SQL} WHERE label = 'signup')"""
IN_FORCE_SQL = f"""(SELECT d.session_id AS session, d.* EXCLUDE (session_id), coalesce(c.profile, 'Events') AS profile, coalesce(c.epoch, 0) AS epoch,
  CASE WHEN c.epoch IS NULL THEN (SELECT min(ts_us) FROM {CHANGES_SQL} x WHERE x.session_id = d.session_id) ELSE c.epoch_end END AS epoch_end
  FROM {DETECTIONS_SQL} d ASOF LEFT JOIN {CHANGES_SQL} c ON c.session_id = d.session_id AND d.ts_us >= c.ts_us)"""


@query("policy_in_force", f"SELECT session AS session_id, seq, ts_us, profile AS profile_name, CAST(epoch AS BIGINT) AS epoch, epoch_end FROM {IN_FORCE_SQL}")
def policy_in_force(spark, sf):
    """The profile in force at each detection, by an as-of join with the changes of its session."""
    rows = op.profiles_in_force(detections(spark, sf), profile_changes(spark, sf), "Events")
    return rows.select("session_id", "seq", "ts_us", "profile_name", "epoch", "epoch_end")


@query(
    "session_profiles",
    f"""{DECISION_SQL}, silent, CAST(epoch AS BIGINT) AS epoch, profile AS profile_name
        FROM {fold_sql(gated_sql(IN_FORCE_SQL, QUIET_CLASSES), SILENCE_US, UNTIL_SQL)}""",
)
def session_profiles(spark, sf):
    """Decisions under the profile in force; an applied profile starts the session afresh."""
    rows = op.decide_under_profiles(
        detections(spark, sf), profile_changes(spark, sf), all_policies(spark), "Events", QUIET_CLASSES,
        silence_us=SILENCE_US, until_us=last_event(spark, sf),
    )
    return D.joined(rows)


# Windows of a day with half a day's step: the given events are hours apart.
LIVE, STEP = "1440 minutes", "720 minutes"
DAY_US, STEP_US = 24 * HOUR_US, 12 * HOUR_US
WINDOWS_SQL = f"""(SELECT session, 0 AS epoch, 'Events' AS profile, CAST(NULL AS BIGINT) AS epoch_end, w AS seq, w * {STEP_US} + {DAY_US} AS ts_us,
    arg_min(label, (-confidence, label)) AS label, max(confidence) AS confidence FROM (
      SELECT session_id AS session, label, confidence, ts_us // {STEP_US} - k AS w FROM {DETECTIONS_SQL}, (VALUES (0), (1)) AS t(k)) GROUP BY session, w)"""


@query("live_window_decisions", f"{DECISION_SQL} FROM {fold_sql(gated_sql(WINDOWS_SQL, D.CLASSES), None)}")
def live_window_decisions(spark, sf):
    """Decisions over sliding windows: the most confident event of each window is its detection."""
    events = table(spark, sf, "events").withColumn("confidence", F.least(F.col("value") / 100.0, F.lit(1.0)))
    heard = window_detections(events, "user_id", "ts", "event_type", "confidence", window=LIVE, step=STEP)
    return D.joined(op.decide(heard, D.event_policies(spark), D.CLASSES))


@query("snapshot_of_state", f"SELECT * FROM ({D.DECISION_SQL} FROM {D.FOLD_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, seq DESC) = 1")
def snapshot_of_state(spark, sf):
    """The latest decision of each session, read from the state of a stream over the events."""
    checkpoint = run_to_state(spark, sf)
    return D.joined(streaming.snapshot_of_state(spark, checkpoint).drop("silent"))


def run_to_state(spark, sf) -> str:
    """Run the decision stream over the events once and return its checkpoint location."""
    ensure_checkpoint_dir(spark)
    checkpoint, out = scratch_path(spark, "decision-stream"), scratch_path(spark, "decided")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, streaming.ROCKSDB[provider])
    try:
        events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern: one file or a folder
        rows = events.select(
            F.col("user_id").alias("session_id"),
            F.col("event_id").alias("seq"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            F.col("event_type").alias("label"),
            F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        )
        decided = streaming.decision_stream(rows, D.event_policies(spark), D.CLASSES)
        run = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return checkpoint
