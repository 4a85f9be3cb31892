"""Policy decisions over ordered detections, as scans instead of a row loop.

Every piece of state of a session is the latest of some kind of row: the start of the
running streak, the last verified row, the last mode change, the last fired response.
Each is the latest non-null value of a column, so a session is one window, or many chunks
when it is too large for one task. Only the cooldown needs a chain, and only over
the rows on which the active class changes.

Times are whole microseconds. Rows of a session are ordered by (ts_us, seq), seq being
unique in the session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, fixed_micros
from ..params import ACTION_LOGS, ACTION_NOTES, NONE_PENDING, UNKNOWN_ACTION, USER_ACTIONS
from ..session import cut_lineage
from .checks import DataContractError
from .ordered import MAX_ROWS_PER_KEY, OrderedRows, Running, as_of, join_keys, per_key, row_index, small_side, split_hot

ORDER = ("ts_us", "seq")
POLICY_COLUMNS = (
    "enabled target_mode confidence_threshold confirm_windows release_seconds cooldown_seconds "
    "high_priority critical quick_action_label notify"
).split()

# The fields of a decision in output order.
DECISION_FIELDS = (
    "detected_class", "detected_confidence", "trigger_enabled", "verification_state", "verified",
    "policy_target_mode", "audio_mode", "preferred_mode", "notification", "warning", "quick_action",
    "quick_action_pending", "release_timer_active", "release_remaining_seconds", "cooldown_active", "restored",
    "reasons", "log",
)


def humanize(label: str | Column) -> Column:
    return F.replace(F.col(label) if isinstance(label, str) else label, F.lit("_"), F.lit(" "))


def micros(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1000000).cast("bigint")


def attach_policy(detections: DataFrame, policies: DataFrame) -> DataFrame:
    """Detections with the policy of their (profile, class) and the profile's preferred mode.

    Without a profile column in the detections, ``policies`` must hold a single profile.
    """
    on = ["profile_name"] if "profile_name" in detections.columns else []
    rows = policies.select(
        *on, F.col("class_name").alias("label"), *POLICY_COLUMNS, fixed("confidence_threshold", 2).alias("_threshold_text")
    )
    profiles = policies.groupBy(*on).agg(
        F.max("preferred_mode").alias("preferred_mode"),
        *([] if on else [F.max("profile_name").alias("profile_name")]),
    )
    out = detections.join(small_side(rows), [*on, "label"], "left")
    if on:
        return out.join(small_side(profiles), on, "left")
    one = profiles.withColumn("_n", policies.agg(F.count_distinct("profile_name")).scalar()).first()
    if one["_n"] > 1:
        raise DataContractError("several profiles: detections need a profile_name")
    return out.withColumns(
        {
            "preferred_mode": F.lit(one["preferred_mode"]).cast("string"),
            "profile_name": F.lit(one["profile_name"]).cast("string"),
        }
    )


def gate(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds trigger_enabled and candidate: a known, enabled class at or above its threshold."""
    confident = F.coalesce(F.col("confidence") >= F.col("confidence_threshold"), F.lit(False))
    rows = rows.withColumn("trigger_enabled", F.coalesce(F.col("enabled"), F.lit(False)))
    return rows.withColumn("candidate", _known(classes) & F.col("trigger_enabled") & confident)


def _known(classes: Sequence[str]) -> Column:
    return F.coalesce(F.col("label").isin(*classes), F.lit(False))


def gate_reason(classes: Sequence[str]) -> Column:
    """Why a gated detection is no candidate, null when it is one."""
    shown = F.coalesce(F.concat(F.lit("'"), "label", F.lit("'")), F.lit("None"))
    return (
        F.when(F.col("candidate"), F.lit(None).cast("string"))
        .when(
            ~_known(classes),
            F.concat(F.lit("detected class "), shown, F.lit(" is not a supported trigger class - no action")),
        )
        .when(
            ~F.col("trigger_enabled"),
            F.concat(F.lit("detected class "), shown, F.lit(" is not enabled in profile '"), "profile_name", F.lit("' - no action")),
        )
        .otherwise(
            F.concat(
                F.lit("confidence "), fixed("confidence", 2), F.lit(" below threshold "), "_threshold_text",
                F.lit(" for "), shown, F.lit(" - no action"),
            )
        )
    )


def persistence(rows: OrderedRows, silence_us: int | None = None) -> OrderedRows:
    """Adds ``n`` (position from 1) and ``streak``: consecutive candidates of the same class.

    With ``silence_us`` a streak also ends when the session sends nothing for longer than that.
    """
    pending = F.when(F.col("candidate"), F.col("label"))
    at = rows.with_columns(pending=pending).running(
        n=Running("sum", F.lit(1), total=silence_us is not None),
        _before=Running("last", F.struct("pending", "ts_us"), exclusive=True),
    )
    goes_on = F.equal_null(F.col("_before.pending"), F.col("label"))
    if silence_us is not None:
        goes_on &= F.col("ts_us") - F.col("_before.ts_us") <= silence_us
    starts = F.col("candidate") & ~F.coalesce(goes_on, F.lit(False))
    at = at.running(_from=Running("last", F.when(starts, F.col("n"))))
    streak = F.when(F.col("candidate"), F.col("n") - F.col("_from") + 1).otherwise(0)
    return at.with_columns(streak=streak)


#: Place of a silent row among the rows of one time: after all of them.
SILENT_SEQ = (1 << 63) - 1


def _silent_rows(rows: OrderedRows, silence_us: int, until: Column | None) -> OrderedRows:
    """Adds a row "nothing heard", ``silent``, wherever the release of the last verified class may fall into a silence.

    A session that sends nothing for longer than ``silence_us`` has heard nothing: its active class is released at
    the end of its release time, or of the silence if that is later, unless a row comes up to then. After the
    last row of a session the time is known up to ``until``.
    """
    last, at = F.col("_last"), F.col("ts_us")
    own = F.when(F.col("verified"), F.struct("n", "label", "ts_us", "_release")).otherwise(last)

    def moment(mark: Column, heard: Column) -> Column:
        return F.greatest(mark["ts_us"] + mark["_release"], heard + silence_us)

    before, after = moment(last, F.col("_before.ts_us")), moment(own, at)
    kinds = [
        F.when(last.isNotNull() & (before < at), F.struct(F.lit(-1).alias("place"), before.alias("t"), last.alias("mark"))),
        F.struct(F.lit(0).alias("place"), at.alias("t"), last.alias("mark")),
    ]
    if until is not None:
        ends = (F.col("n") == 2 * F.col("n_total")) & own.isNotNull() & (after < until)
        kinds.append(F.when(ends, F.struct(F.lit(1).alias("place"), after.alias("t"), own.alias("mark"))))
    df = rows.df.withColumn("_k", F.explode(F.array_compact(F.array(*kinds))))
    silent = F.col("_k.place") != 0

    def unless_silent(name: str, value=None) -> Column:
        return F.when(silent, F.lit(value).cast(df.schema[name].dataType)).otherwise(F.col(name))

    cols = {"silent": silent, "n": F.col("n") + F.col("_k.place"), "ts_us": F.col("_k.t"), "_last": F.col("_k.mark")}
    cols |= {c: unless_silent(c) for c in ("label", "confidence", "pending", "_release", *POLICY_COLUMNS)}
    cols |= {c: unless_silent(c, False) for c in ("trigger_enabled", "candidate", "verified")}
    cols |= {"streak": unless_silent("streak", 0), "seq": unless_silent("seq", SILENT_SEQ)}
    if rows.chunked:
        cols["_pos"] = 2 * F.col("_pos") + F.col("_k.place")
    return replace(rows, df=df.withColumns(cols).drop("_k"), fixed=False)


def verification(rows: OrderedRows, silence_us: int | None = None, until: Column | None = None) -> OrderedRows:
    """Adds verified, restored, fire_edge and the active class after each row, with its timer.

    With ``silence_us`` also a row for each release that falls into a silence, marked ``silent``.
    """
    verified = F.col("candidate") & (F.col("streak") >= F.col("confirm_windows"))
    rows = rows.with_columns(verified=verified, _release=micros("release_seconds"))
    if silence_us is not None:
        rows = rows.with_columns(n=2 * F.col("n"))  # room for a silent row on either side
    mark = F.when(F.col("verified"), F.struct("n", "label", "ts_us", "_release"))
    rows = rows.running(_last=Running("last", mark, exclusive=True))
    if silence_us is not None:
        rows = _silent_rows(rows, silence_us, until)
    absent = (
        ~F.col("verified")
        & F.col("_last").isNotNull()
        & ~F.equal_null(F.col("pending"), F.col("_last.label"))
        & (F.col("ts_us") - F.col("_last.ts_us") >= F.col("_last._release"))
    )
    rows = rows.with_columns(_absent=F.when(absent, F.col("n"))).running(
        _gone=Running("last", F.col("_absent"), exclusive=True)
    )
    # The class stays active until the first absent row after its last verified row.
    alive = F.col("_last").isNotNull() & ~F.coalesce(F.col("_gone") > F.col("_last.n"), F.lit(False))
    before = F.when(alive, F.col("_last.label"))
    restored = alive & F.col("_absent").isNotNull()
    current = F.col("verified")
    rows = rows.with_columns(
        restored=restored,
        fire_edge=current & ~F.equal_null(before, F.col("label")),
        active_class=F.when(current, F.col("label")).when(~restored, before),
        _seen=F.when(current, F.col("ts_us")).otherwise(F.col("_last.ts_us")),
        _timer=F.when(current, F.col("_release")).otherwise(F.col("_last._release")),
    )
    # A silence in which nothing was active changes nothing.
    return rows if silence_us is None else replace(rows, df=rows.df.filter("restored OR NOT silent"))


def audio_mode(rows: OrderedRows) -> OrderedRows:
    """Adds the mode after each row: the target of a verified class, the preferred one once restored."""
    sets_target = F.col("verified") & F.col("target_mode").isNotNull()
    mode = F.when(sets_target, F.col("target_mode")).otherwise(F.col("preferred_mode"))
    event = F.when(sets_target | F.col("restored"), F.struct(mode.alias("mode")))
    rows = rows.running(_mode=Running("last", event))
    return rows.with_columns(
        audio_mode=F.when(F.col("_mode").isNull(), F.col("preferred_mode")).otherwise(F.col("_mode.mode"))
    )


def cooldown_fires(edges: DataFrame, keys: Sequence[str], chunked: bool) -> DataFrame:
    """(keys, n) of the edges whose response fires.

    An edge fires unless it falls before the end of the cooldown that the last fired edge
    of its class began; a suppressed edge does not extend it. ``edges`` has keys, label, n,
    ts_us, _cooldown.
    """
    if chunked:
        return _fires_by_doubling(edges, keys)
    by = [*keys, "label"]

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Groups arrive one after the other and may cross batches: only (key, end) is carried.
        last, end = None, 0
        for pdf in parts:
            if not len(pdf):
                continue
            t, wait = pdf["ts_us"].to_numpy(), pdf["_cooldown"].to_numpy()
            cols = [pdf[c].astype(object).where(pdf[c].notna(), None).to_numpy() for c in by]
            new = np.any([np.append(True, c[1:] != c[:-1]) for c in cols], axis=0)
            starts = np.append(np.flatnonzero(new), len(t))
            fired = []
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(c[a] for c in cols)
                i = a + int(np.searchsorted(t[a:b], end)) if key == last else a
                while i < b:
                    fired.append(i)
                    end = t[i] + wait[i]
                    i = max(i + 1, a + int(np.searchsorted(t[a:b], end)))
                last = key
            yield pdf.iloc[fired][[*keys, "n"]]

    rows = edges.select(*by, "n", "ts_us", "_cooldown").repartition(*by).sortWithinPartitions(*by, "n")
    return rows.mapInPandas(chain, edges.select(*keys, "n").schema)


def _fires_by_doubling(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for sessions too large for one task: follow next-fire pointers by doubling.

    The number of rounds is the logarithm of the longest chain, which is at most the time
    span over the cooldown.
    """
    by = [*keys, "label"]
    rows = cut_lineage(row_index(edges.select(*by, "n", "ts_us", "_cooldown"), by, ["n"], "i"))
    # Next edge at or after the end of the cooldown: count the edges before that time.
    probes = rows.select(*by, (F.col("ts_us") + F.col("_cooldown")).alias("t"), F.lit(0).alias("is_edge"), "i", "i_total")
    marks = rows.select(*by, F.col("ts_us").alias("t"), F.lit(1).alias("is_edge"), "i", "i_total")
    counted = OrderedRows.of(probes.unionByName(marks), by, ["t", "is_edge", "i"], chunked=True)
    counted = counted.running(j=Running("sum", F.col("is_edge"))).result().filter("is_edge = 0")
    jump = cut_lineage(
        counted.select(*by, "i", F.greatest(F.col("j"), F.col("i") + 1).alias("j"), "i_total")
        .filter(F.col("j") < F.col("i_total"))
        .drop("i_total")
    )
    fired = rows.filter("i = 0").select(*by, "i")
    while True:
        step = cut_lineage(fired.join(jump, [*by, "i"]).select(*by, F.col("j").alias("i")))
        if step.isEmpty():
            break
        fired = cut_lineage(fired.unionByName(step))
        onward = jump.select(*by, F.col("i").alias("j"), F.col("j").alias("_j2"))
        jump = cut_lineage(jump.join(onward, [*by, "j"]).select(*by, "i", F.col("_j2").alias("j")))
    return rows.join(fired, [*by, "i"], "left_semi").select(*keys, "n")


def response_text(label: str, target_mode: str) -> dict[str, Column]:
    """Notification and warning wording."""
    found = F.concat(humanize(label), F.lit(" detected"))
    return {
        "notification": F.when(
            F.col(target_mode).isNotNull(), F.concat(found, F.lit(" - "), F.col(target_mode), F.lit(" enabled"))
        ).otherwise(found),
        "warning": F.concat(F.lit("[WARNING] "), found),
    }


def responses(rows: DataFrame) -> DataFrame:
    """Adds what a fired edge presents: notification, warning, quick action."""
    text = response_text("label", "target_mode")
    fired = F.col("fired")
    return rows.withColumns(
        {
            "notification": F.when(fired & F.col("notify"), text["notification"]),
            "warning": F.when(fired & F.col("high_priority"), text["warning"]),
            "quick_action": F.when(fired & F.col("critical"), F.col("quick_action_label")),
            "_shows_action": fired & F.coalesce(F.col("critical"), F.lit(False)),
        }
    )


def pending_and_cooldown(rows: OrderedRows) -> OrderedRows:
    """Adds the action pending after (and before) each row, and whether any cooldown is running.

    Rows may include user actions (``action`` not null): confirm and reject clear the pending action, an
    unknown one is refused and changes nothing.
    """
    shows = F.col("_shows_action")
    clears = F.col("restored") | F.coalesce(F.col("action").isin(*USER_ACTIONS), F.lit(False))
    event = F.when(
        shows | clears,
        F.struct(
            F.when(shows, F.col("quick_action_label")).alias("text"),
            F.when(shows, F.col("label")).alias("class_name"),
        ),
    )
    until = F.when(F.col("fired"), F.col("ts_us") + micros("cooldown_seconds"))
    rows = rows.running(
        _qa=Running("last", event),
        _qa_before=Running("last", event, exclusive=True),
        _until=Running("max", until),
    )
    return rows.with_columns(
        quick_action_pending=F.coalesce(F.col("_qa.text").isNotNull(), F.lit(False)),
        cooldown_active=F.coalesce(F.col("_until") > F.col("ts_us"), F.lit(False)),
    )


def verification_state() -> Column:
    return (
        F.when(F.col("verified"), "verified")
        .when(F.col("restored"), "released")
        .when(F.col("candidate"), "pending")
        .otherwise("idle")
    )


def messages_of(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds the reasons and the time-stamped log lines of each decision."""
    quoted = F.concat(F.lit("'"), "label", F.lit("'"))
    suppressed = F.col("fire_edge") & ~F.col("fired")
    stamp = F.concat(F.lit("t="), fixed_micros("ts_us", 2), F.lit(" "))
    release = fixed_micros("_last._release", 1)
    lines = F.array_compact(
        F.array(
            F.when(suppressed, F.concat(F.lit("response suppressed by cooldown for "), quoted)),
            F.concat(F.lit("notification: "), "notification"),
            F.concat(F.lit("warning: "), "warning"),
            F.concat(F.lit("quick action presented (awaiting user confirmation): "), "quick_action"),
            F.when(
                F.col("restored"),
                F.concat(F.lit("trigger '"), "_last.label", F.lit("' absent for "), release, F.lit("s - preferred mode restored")),
            ),
            F.when(
                F.col("verification_state") == "pending",
                F.concat(F.lit("awaiting persistence "), "streak", F.lit("/"), "confirm_windows", F.lit(" for "), quoted),
            ),
        )
    )
    reasons = F.array_compact(
        F.array(
            gate_reason(classes),
            F.when(suppressed, F.concat(F.lit("response for "), quoted, F.lit(" suppressed by cooldown (duplicate alert)"))),
        )
    )
    return rows.withColumns({"reasons": reasons, "log": F.transform(lines, lambda m: F.concat(stamp, m))})


def decide(
    detections: DataFrame,
    policies: DataFrame,
    classes: Sequence[str],
    keys: Sequence[str] = ("session_id",),
    actions: DataFrame | None = None,
    max_rows: int = MAX_ROWS_PER_KEY,
    silence_us: int | None = None,
    until: Column | int | None = None,
) -> DataFrame:
    """One decision per detection: keys, seq, ts_us and the 18 decision fields.

    Detections without a session key are one session.

    ``detections``: keys, seq, ts_us, label, confidence (and profile_name). ``actions``: keys,
    seq, ts_us, action ("confirm" / "reject") of the user, in the same order space. Sessions
    above ``max_rows`` rows are scanned in chunks, with the same result.

    Without ``silence_us`` a class is released by the next detection only. With it, a session that sends nothing for
    longer than that has heard nothing: a streak ends, and the release itself is a row without ``seq``, marked
    ``silent`` (see ``_silent_rows``). ``until`` is the time in microseconds up to which sessions are known, a number
    or a column of the detections; without it nothing is known after the last row of a session.
    """
    if silence_us is not None and silence_us < 1:
        raise ValueError("a silence takes some time")
    rows = _scan(detections, policies, classes, keys, actions, max_rows, silence_us, until).filter("action IS NULL")
    if silence_us is None:
        return rows.select(*keys, "seq", "ts_us", *DECISION_FIELDS)
    seq = F.when(~F.col("silent"), F.col("seq")).alias("seq")
    return rows.select(*keys, seq, "ts_us", *DECISION_FIELDS, "silent")


def quick_action_results(
    detections: DataFrame,
    policies: DataFrame,
    classes: Sequence[str],
    actions: DataFrame,
    keys: Sequence[str] = ("session_id",),
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Outcome of each user action; nothing is ever executed, and none pending is an error."""
    rows = _scan(detections, policies, classes, keys, actions, max_rows).filter("action IS NOT NULL")
    text = F.col("_qa_before.text")
    valid = F.col("action").isin(*USER_ACTIONS)
    error = F.when(~valid, UNKNOWN_ACTION).when(text.isNull(), NONE_PENDING)
    confirmed = F.col("action") == "confirm"
    cls = F.col("_qa_before.class_name")
    stamp = F.concat(F.lit("t="), fixed_micros("ts_us", 2), F.lit(" "))
    log = F.when(confirmed, F.format_string(ACTION_LOGS["confirm"], cls, text)).otherwise(
        F.format_string(ACTION_LOGS["reject"], cls, text)
    )
    note = F.when(confirmed, ACTION_NOTES["confirm"]).otherwise(ACTION_NOTES["reject"])
    ok = error.isNull()
    return rows.select(
        *keys,
        "seq",
        "ts_us",
        "action",
        F.when(ok, cls).alias("class_name"),
        F.when(ok, text).alias("quick_action_label"),
        F.when(ok, confirmed).alias("confirmed"),
        F.lit(False).alias("executed"),
        F.when(ok, note).alias("note"),
        F.when(ok, F.concat(stamp, log)).alias("log"),
        error.alias("error"),
    )


def _scan(detections, policies, classes, keys, actions, max_rows, silence_us=None, until=None) -> DataFrame:
    cold, hot = split_hot(detections, keys, max_rows)
    parts = [(cold, False)] + ([(hot, True)] if hot is not None else [])
    out = None
    for rows, chunked in parts:
        mine = actions
        if actions is not None and hot is not None:
            mine = join_keys(actions, hot.select(*keys).distinct(), keys, "left_semi" if chunked else "left_anti")
        done = _scan_part(rows, policies, classes, list(keys), mine, chunked, silence_us, until)
        out = done if out is None else out.unionByName(done)
    return out


def _scan_part(detections, policies, classes, keys, actions, chunked, silence_us, until) -> DataFrame:
    # The narrow detections are shuffled; the policy joins them where they land. The number of
    # partitions is given, as the scans cost more than the small shuffled size suggests.
    if not chunked:
        n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        detections = detections.repartition(n, *keys)
    ordered = OrderedRows.of(detections, keys, ORDER, chunked)
    gated = replace(ordered, df=gate(attach_policy(ordered.df, policies), classes))
    end = F.lit(until) if isinstance(until, int) else until
    rows = audio_mode(verification(persistence(gated, silence_us), silence_us, end)).result()
    if chunked:
        rows = cut_lineage(rows)
    edges = rows.filter("fire_edge").select(*keys, "label", "n", "ts_us", micros("cooldown_seconds").alias("_cooldown"))
    fires = cooldown_fires(edges, keys, chunked).withColumn("fired", F.lit(True))
    rows = join_keys(rows, fires, [*keys, "n"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    rows = responses(rows).withColumn("action", F.lit(None).cast("string"))
    if actions is not None:
        asked = actions.select(*keys, "seq", "ts_us", "action").withColumns(
            {"restored": F.lit(False), "_shows_action": F.lit(False), "fired": F.lit(False)}
        )
        rows = rows.unionByName(asked, allowMissingColumns=True)
    rows = pending_and_cooldown(OrderedRows.of(rows, keys, ORDER, chunked)).result()
    live = F.col("active_class").isNotNull()
    remaining = F.greatest(F.lit(0).cast("bigint"), F.col("_timer") - (F.col("ts_us") - F.col("_seen")))
    rows = rows.withColumns(
        {
            "detected_class": F.col("label"),
            "detected_confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
            "verification_state": verification_state(),
            "policy_target_mode": F.col("target_mode"),
            "release_timer_active": live & ~F.col("verified"),
            "release_remaining_seconds": F.when(live, remaining / 1000000.0),
        }
    )
    return messages_of(rows, classes)


def decision_log(decisions: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per log line."""
    return decisions.select(*keys, "seq", "ts_us", F.posexplode("log").alias("line", "message"))


def virtual_clock(
    steps: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Time and detection of each step of a session driven by hand.

    ``steps``: kind "prediction" (sets the last label and confidence) or "step", with
    advance_us, label_given, label, confidence. A step without a label repeats the last
    prediction; an explicit null label means nothing was heard; a label without confidence
    takes the last one, or 1. A refused step leaves the clock where it is.
    """
    sets = F.col("kind") == "prediction"

    def scan(rows: OrderedRows) -> DataFrame:
        mark = F.when(sets, F.struct("label", "confidence"))
        rows = rows.running(_last=Running("last", mark, exclusive=True))
        error = F.when(F.col("advance_us") < 0, "advance_seconds must be >= 0").when(
            ~F.col("label_given") & F.col("_last.label").isNull(), "no detection yet - analyze a clip first"
        )
        rows = rows.with_columns(error=F.when(~sets, error))
        moves = F.when(~sets & F.col("error").isNull(), F.col("advance_us")).otherwise(0)
        rows = rows.running(now_us=Running("sum", moves))
        # A last confidence of 0 counts as none when an explicit label needs one.
        last = F.col("_last.confidence")
        detected = F.when(F.col("label_given"), F.col("label")).otherwise(F.col("_last.label"))
        confidence = (
            F.when(~F.col("label_given"), F.coalesce(last, F.lit(0.0)))
            .when(F.col("label").isNull(), F.lit(0.0))
            .otherwise(F.coalesce("confidence", F.when(last != 0, last), F.lit(1.0)))
        )
        ok = F.col("error").isNull()
        return (
            rows.result()
            .filter(~sets)
            .select(
                *keys,
                *order,
                "now_us",
                F.when(ok, detected).alias("detected"),
                F.when(ok, confidence).alias("detected_confidence"),
                "error",
            )
        )

    return per_key(steps, keys, order, scan, max_rows)


def session_epochs(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], resets: Column, max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Adds ``epoch``: the number of resets up to and including the row; a reset starts a fresh session."""

    def scan(part: OrderedRows) -> DataFrame:
        return part.running(epoch=Running("sum", F.when(resets, 1).otherwise(0))).result()

    return per_key(rows, keys, order, scan, max_rows)


def profiles_in_force(
    rows: DataFrame, changes: DataFrame, first: str, keys: Sequence[str] = ("session_id",), max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Adds the ``profile_name`` in force at each row, its ``epoch`` in the session (0 before any change, where the
    profile is ``first``) and when the epoch ends, ``epoch_end`` (null for the last one).

    ``changes``: keys, ts_us, seq, profile_name. A change at the time of a row is in force for it. Every change
    begins an epoch, also one to the profile in force.
    """
    numbered = row_index(changes.select(*keys, "ts_us", "seq", "profile_name"), list(keys), ["ts_us", "seq"], "_i").drop("_i_total")
    numbered = cut_lineage(numbered)
    begun = numbered.withColumn("epoch", F.col("_i") + 1)
    out = as_of(rows.drop("profile_name"), begun, keys, "ts_us", ["profile_name", "epoch"], ["epoch"], max_rows)
    out = out.withColumns(
        {"profile_name": F.coalesce("profile_name", F.lit(first)), "epoch": F.coalesce("epoch", F.lit(0).cast("bigint"))}
    )
    ends = numbered.select(*keys, F.col("_i").alias("epoch"), F.col("ts_us").alias("epoch_end"))
    return join_keys(out, ends, [*keys, "epoch"], "left")


def decide_under_profiles(
    detections: DataFrame,
    changes: DataFrame,
    policies: DataFrame,
    first: str,
    classes: Sequence[str],
    keys: Sequence[str] = ("session_id",),
    max_rows: int = MAX_ROWS_PER_KEY,
    silence_us: int | None = None,
    until_us: int | None = None,
) -> DataFrame:
    """``decide`` under the profile in force at each detection: keys, epoch, profile_name and the decision.

    A profile that is applied starts the session afresh: streak, active class, mode, cooldowns and a pending action
    are those of a new session. What is silent at the end of an epoch is released only if that comes first.
    """
    rows = profiles_in_force(detections, changes, first, keys, max_rows)
    until = None
    if silence_us is not None:
        known = F.lit(until_us).cast("bigint")
        until = F.least("epoch_end", known) if until_us is not None else F.col("epoch_end")
    return decide(rows, policies, classes, [*keys, "epoch", "profile_name"], None, max_rows, silence_us, until)


def session_snapshot(decisions: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Latest decision of each session; a map-side combined aggregate."""
    rest = [c for c in decisions.columns if c not in keys]
    latest = decisions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_us", "seq")).alias("_d"))
    return latest.select(*keys, "_d.*")
