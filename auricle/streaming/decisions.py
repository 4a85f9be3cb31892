"""The decision stream: typed keyed state per session, constant in size.

Needs the RocksDB state store (``ROCKSDB``). Rows of a micro-batch are put in (ts_us, seq)
order inside their session; a row that comes after a later one was already decided cannot
change the past and is returned marked ``late``.

Beside detections the stream may carry what the user does (``action``) and profiles that are applied in
mid-session (``policies``). With a silence given, a session that sends nothing is released by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import fields
from types import SimpleNamespace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import POLICY_COLUMNS, SILENT_SEQ, attach_policy, gate, gate_reason
from .transition import SessionState, advance, answer, hear, release_silent

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

_FIELDS = (
    "detected_class string, detected_confidence double, trigger_enabled boolean, verification_state string, "
    "verified boolean, policy_target_mode string, audio_mode string, preferred_mode string, notification string, "
    "warning string, quick_action string, quick_action_pending boolean, release_timer_active boolean, "
    "release_remaining_seconds double, cooldown_active boolean, restored boolean, reasons array<string>, log array<string>"
)
_ACTION_FIELDS = (
    "action string, class_name string, quick_action_label string, confirmed boolean, executed boolean, note string, "
    "error string"
)
_STATE = (
    "mode string, pending string, run bigint, active string, release_us bigint, seen_us bigint, action string, "
    "action_class string, until map<string, bigint>, profile string, applied boolean, preferred string, heard_us bigint, "
    "ts_us bigint, seq bigint, timer_ms bigint"
)
_POLICY = (
    "class_name string, enabled boolean, target_mode string, confidence_threshold double, confirm_windows int, "
    "release_seconds double, cooldown_seconds double, high_priority boolean, critical boolean, quick_action_label string, "
    "notify boolean"
)
_LATEST = f"ts_us bigint, seq bigint, {_FIELDS}, silent boolean"
RESET, APPLY = "reset", "apply"


def _names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).names


def output_schema(key_type: str, actions: bool = False, silence: bool = False, profiles: bool = False) -> str:
    more = f", {_ACTION_FIELDS}" if actions or profiles else ""
    more += ", silent boolean" if silence else ""
    more += ", profile_name string" if profiles else ""
    return f"session_id {key_type}, seq bigint, ts_us bigint, {_FIELDS}, late boolean{more}"


class DecisionProcessor(StatefulProcessor):
    """State: ``session`` (typed), ``decision`` (the latest one, for readers of the state) and ``policies`` (of the
    profile that was applied to the session, one row per class; empty under the stream's own policies)."""

    def __init__(self, names: Sequence[str], classes: Sequence[str], actions: bool, silence_us: int | None, profiles: bool):
        self._names, self._classes = list(names), frozenset(classes)
        self._made = Row(*names)
        # Made on the driver: workers have no session to parse them with.
        self._state, self._policy, self._latest = map(T.StructType.fromDDL, (_STATE, _POLICY, _LATEST))
        self._name = T.StructType.fromDDL("class_name string")
        self._actions, self._silence_us, self._profiles = actions or profiles, silence_us, profiles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._session = handle.getValueState("session", self._state)
        self._decision = handle.getValueState("decision", self._latest)
        if self._profiles:
            self._policies = handle.getMapState("policies", self._name, self._policy)

    def _load(self):
        """(session or None, (ts_us, seq) of the last row or None, its timer)."""
        if not self._session.exists():
            return None, None, None
        stored = dict(zip(self._state.names, self._session.get()))
        at, timer = (stored.pop("ts_us"), stored.pop("seq")), stored.pop("timer_ms")
        stored["until"] = dict(stored["until"] or {})
        return SessionState(**stored), at, timer

    def _store(self, state: SessionState, last: tuple[int, int], timer: int | None) -> None:
        if self._silence_us is not None:
            wanted = state.silent_from(self._silence_us)
            # A timer fires once the watermark has passed its millisecond.
            wanted = None if wanted is None else wanted // 1000 + 1
            if wanted != timer:
                if timer is not None:
                    self._handle.deleteTimer(timer)
                if wanted is not None:
                    self._handle.registerTimer(wanted)
                timer = wanted
        values = {f.name: getattr(state, f.name) for f in fields(SessionState)}
        self._session.update(tuple((values | {"ts_us": last[0], "seq": last[1], "timer_ms": timer})[n] for n in self._state.names))

    def _row(self, key, state: SessionState, seq: int | None, ts_us: int, **more) -> dict:
        row = dict.fromkeys(self._names) | {"session_id": key[0], "seq": seq, "ts_us": ts_us, "late": False, "silent": False}
        row |= {"profile_name": None if state is None else state.profile} | more
        return row

    def _silent(self, key, state: SessionState, at_us: int) -> dict:
        row = self._row(key, state, None, at_us, silent=True, detected_confidence=0.0, trigger_enabled=False)
        return row | {"preferred_mode": state.preferred} | release_silent(state, at_us)

    def _gated(self, state: SessionState, row: SimpleNamespace) -> SimpleNamespace:
        """The detection under the profile in force: as it came, or gated anew under an applied one."""
        if not state.applied:
            return row
        given = SimpleNamespace(**vars(row))
        known = row.label in self._classes
        listed = row.label is not None and self._policies.containsKey((row.label,))
        stored = self._policies.getValue((row.label,)) if listed else None
        policy = dict(zip(self._policy.names, stored)) if stored is not None else dict.fromkeys(self._policy.names)
        for name in POLICY_COLUMNS:
            setattr(given, name, policy[name])
        given.preferred_mode = state.preferred
        given.trigger_enabled = bool(policy["enabled"])
        enough = row.confidence is not None and policy["confidence_threshold"] is not None
        enough = enough and not row.confidence < policy["confidence_threshold"]  # as in Spark, NaN is above
        given.candidate, given.gate_reason = known and given.trigger_enabled and enough, None
        shown = "None" if row.label is None else f"'{row.label}'"
        if not known:
            given.gate_reason = f"detected class {shown} is not a supported trigger class - no action"
        elif not given.trigger_enabled:
            given.gate_reason = f"detected class {shown} is not enabled in profile '{state.profile}' - no action"
        elif not enough and row.confidence is not None:
            limit = policy["confidence_threshold"]
            given.gate_reason = f"confidence {row.confidence:.2f} below threshold {limit:.2f} for {shown} - no action"
        return given

    def _apply(self, row) -> SessionState:
        """A profile is applied: the session starts afresh under it."""
        self._policies.clear()
        for policy in row.policies:
            values = dict(policy) if isinstance(policy, dict) else policy.asDict()
            self._policies.updateValue((values["class_name"],), tuple(values[n] for n in self._policy.names))
        return SessionState(mode=row.preferred_mode, preferred=row.preferred_mode, profile=row.profile_name, applied=True)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, last, timer = self._load()
        out, decided = [], None
        # Fields of a Row are found by a search each time; these rows are read many times.
        heard = (SimpleNamespace(**dict(zip(row.__fields__, row))) for row in rows)
        for row in sorted(heard, key=lambda r: (r.ts_us, r.seq)):
            at = (int(row.ts_us), int(row.seq))
            late = last is not None and at <= last
            if state is not None and self._silence_us is not None and not late:
                silent = state.silent_from(self._silence_us)
                if silent is not None and silent < at[0]:
                    decided = self._silent(key, state, silent)
                    out.append(decided)
            asked = row.action if self._actions else None
            if asked is not None:
                base = self._row(key, state, at[1], at[0], late=late, action=asked, executed=False)
                if not late:
                    if asked == APPLY:
                        state = self._apply(row)
                        base["profile_name"] = state.profile
                    elif state is None or asked == RESET:
                        state = self._fresh(state, row)
                    if asked not in (RESET, APPLY):
                        base.update(answer(state, row))
                    last = at
                out.append(base)
                continue
            if not late:
                state = state or self._fresh(None, row)
                row = self._gated(state, row)
            base = self._row(
                key,
                state,
                at[1],
                at[0],
                late=late,
                detected_class=row.label,
                detected_confidence=0.0 if row.confidence is None else row.confidence,
                trigger_enabled=bool(row.trigger_enabled),
                policy_target_mode=row.target_mode,
                preferred_mode=row.preferred_mode,
            )
            if not late:
                hear(state, at[0], self._silence_us)
                base.update(advance(state, row))
                last, decided = at, base
            out.append(base)
        if state is not None:
            self._store(state, last, timer)
        self._publish(decided)
        return self._given(out)

    def _given(self, out: list[dict]) -> Iterator[Row]:
        return (self._made(*map(row.get, self._names)) for row in out)

    def _fresh(self, state: SessionState | None, row) -> SessionState:
        """A session under the profile in force so far, or the stream's own."""
        if state is not None:
            return SessionState(mode=state.preferred, preferred=state.preferred, profile=state.profile, applied=state.applied)
        return SessionState(mode=row.preferred_mode, preferred=row.preferred_mode, profile=row.profile_name)

    def _publish(self, decided: dict | None) -> None:
        if decided is not None:
            self._decision.update(tuple(decided.get(n) for n in self._latest.names))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, last, timer = self._load()
        out = []
        if state is not None and timer == expiredTimerInfo.getExpiryTimeInMs():
            silent = state.silent_from(self._silence_us)
            out.append(self._silent(key, state, silent))
            self._publish(out[0])
            self._store(state, (silent, SILENT_SEQ), None)
        return self._given(out)

    def close(self) -> None:
        pass


def profile_rows(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows that apply a profile to a session, as input of ``decision_stream``.

    ``changes`` (a table or a stream): session_id, ts_us, seq, profile_name; ``policies``: rows of all profiles. A
    change to a profile without policies enables nothing.
    """
    policy = F.struct(*[F.col(n).cast(T.StructType.fromDDL(_POLICY)[n].dataType).alias(n) for n in _names(_POLICY)])
    profiles = policies.groupBy("profile_name").agg(F.max("preferred_mode").alias("preferred_mode"), F.collect_list(policy).alias("policies"))
    return changes.join(profiles, "profile_name", "left").select(
        "session_id", "seq", "ts_us", F.lit(APPLY).alias("action"), "profile_name", "preferred_mode",
        F.coalesce("policies", F.array()).alias("policies"),
    )


def decision_stream(
    detections: DataFrame,
    policies: DataFrame,
    classes: Sequence[str],
    silence_us: int | None = None,
    lateness: str = "10 seconds",
    applied: DataFrame | None = None,
) -> DataFrame:
    """Decisions of a stream of (session_id, seq, ts_us, label, confidence).

    With a column ``action`` the stream also carries what the user does, in the same order space: "confirm" and
    "reject" answer the pending quick action, "reset" starts the session afresh, anything else
    is refused. Such a row returns the outcome of the action and no decision.

    ``applied`` (see ``profile_rows``) is a second input: a profile that is applied starts the session afresh under
    its policies, from its time on. ``policies`` hold the one profile of sessions to which none was applied.

    The stream's own policies are joined and the gate applied before the keyed state; the state holds the policies of
    an applied profile only.

    With ``silence_us`` the stream equals the batch with the same silence: streaks end in a silence and releases come
    as rows of their own, marked ``silent``, as soon as a later row of the session comes or the watermark
    (``lateness`` behind the latest row of all sessions) has passed. Rows older than the watermark are dropped.
    """
    actions = "action" in detections.columns
    key_type = detections.schema["session_id"].dataType.simpleString()
    rows = gate(attach_policy(detections, policies), classes).withColumn("gate_reason", gate_reason(classes))
    rows = rows.drop("enabled", "confidence_threshold", "_threshold_text")  # what the gate alone reads
    if applied is not None:
        rows = rows.unionByName(applied, allowMissingColumns=True)
    mode = "None"
    if silence_us is not None:
        if silence_us < 1:
            raise ValueError("a silence takes some time")
        rows, mode = rows.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", lateness), "EventTime"
    schema = output_schema(key_type, actions, silence_us is not None, applied is not None)
    return rows.groupBy("session_id").transformWithState(
        statefulProcessor=DecisionProcessor(_names(schema), classes, actions, silence_us, applied is not None),
        outputStructType=T.StructType.fromDDL(schema),
        outputMode="Append",
        timeMode=mode,
    )


def snapshot_of_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Latest decision of each session of a running (or ended) stream, from its state.

    Reads the state store below the query's ``checkpoint`` location, as of the last committed micro-batch or after
    ``batch_id``: the stream is not touched, nothing is recomputed, and the rows are one per session.
    """
    reader = spark.read.format("statestore").option("stateVarName", "decision")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    rows = reader.load(checkpoint)
    latest = rows.select(F.col("key.session_id").alias("session_id"), "value.*")
    return latest.withColumn("silent", F.coalesce("silent", F.lit(False)))
