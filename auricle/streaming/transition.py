"""One detection at a time: the state of a session and how a gated detection changes it."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import SimpleNamespace

from ..params import ACTION_LOGS, ACTION_NOTES, NONE_PENDING, UNKNOWN_ACTION, USER_ACTIONS


@dataclass
class SessionState:
    """Constant-size state of one session (the cooldowns are bounded by the taxonomy)."""

    mode: str | None
    pending: str | None = None
    run: int = 0
    active: str | None = None
    release_us: int = 0
    seen_us: int = 0
    action: str | None = None
    action_class: str | None = None
    until: dict[str, int] = field(default_factory=dict)
    #: Profile in force, whether it was applied in mid-session, and its mode; when the last detection came.
    profile: str | None = None
    applied: bool = False
    preferred: str | None = None
    heard_us: int | None = None

    def clear_trigger(self) -> None:
        self.active = self.action = self.action_class = None

    def silent_from(self, silence_us: int) -> int | None:
        """When the active class is released unless something is heard up to then; None without one."""
        if self.active is None or self.heard_us is None:
            return None
        return max(self.seen_us + self.release_us, self.heard_us + silence_us)


NOTHING_HEARD = SimpleNamespace(label=None, candidate=False, gate_reason="detected class None is not a supported trigger class - no action")


def release_silent(state: SessionState, at_us: int) -> dict:
    """The decision on hearing nothing: the active class is released."""
    row = SimpleNamespace(**vars(NOTHING_HEARD), ts_us=at_us, preferred_mode=state.preferred)
    return advance(state, row)


def hear(state: SessionState, at_us: int, silence_us: int | None) -> None:
    """A detection comes; a streak does not outlast a silence."""
    if silence_us is not None and state.heard_us is not None and at_us - state.heard_us > silence_us:
        state.pending, state.run = None, 0
    state.heard_us = at_us


def _seconds(us: int, digits: int) -> str:
    unit = 10 ** (6 - digits)
    whole, rest = divmod(us, unit)
    whole += rest * 2 > unit or (rest * 2 == unit and whole % 2 == 1)
    return f"{whole // 10**digits}.{whole % 10**digits:0{digits}d}"


def advance(state: SessionState, row) -> dict:
    """Apply one gated detection (policy columns attached) and return the decision's varying fields."""
    now, label = int(row.ts_us), row.label
    lines: list[str] = []
    reasons = [row.gate_reason] if row.gate_reason is not None else []

    if row.candidate:
        state.run = state.run + 1 if state.pending == label else 1
        state.pending = label
    else:
        state.pending, state.run = None, 0
    verified = bool(row.candidate) and state.run >= int(row.confirm_windows)

    out = {"notification": None, "warning": None, "quick_action": None, "restored": False}
    if verified:
        changed = state.active != label
        state.active, state.seen_us = label, now
        state.release_us = round(row.release_seconds * 1_000_000)
        if row.target_mode is not None:
            state.mode = row.target_mode
        if changed:
            _respond(state, row, now, out, reasons, lines)
    elif state.active is not None and state.pending != state.active and now - state.seen_us >= state.release_us:
        state.mode = row.preferred_mode
        out["restored"] = True
        gone = _seconds(state.release_us, 1)
        lines.append(f"trigger '{state.active}' absent for {gone}s - preferred mode restored")
        state.clear_trigger()

    if verified:
        kind = "verified"
    elif out["restored"]:
        kind = "released"
    elif row.candidate:
        kind = "pending"
        lines.append(f"awaiting persistence {state.run}/{int(row.confirm_windows)} for '{label}'")
    else:
        kind = "idle"
    live = state.active is not None
    out.update(
        verification_state=kind,
        verified=verified,
        audio_mode=state.mode,
        quick_action_pending=state.action is not None,
        release_timer_active=live and not verified,
        release_remaining_seconds=max(0, state.release_us - (now - state.seen_us)) / 1_000_000 if live else None,
        cooldown_active=any(u > now for u in state.until.values()),
        reasons=reasons,
        log=[f"t={_seconds(now, 2)} {m}" for m in lines],
    )
    return out


def _respond(state: SessionState, row, now: int, out: dict, reasons: list, lines: list) -> None:
    """Present the response of a newly active class, unless its cooldown is running."""
    if now < state.until.get(row.label, now):
        reasons.append(f"response for '{row.label}' suppressed by cooldown (duplicate alert)")
        lines.append(f"response suppressed by cooldown for '{row.label}'")
        return
    found = f"{row.label.replace('_', ' ')} detected"
    if row.notify:
        out["notification"] = found if row.target_mode is None else f"{found} - {row.target_mode} enabled"
        lines.append(f"notification: {out['notification']}")
    if row.high_priority:
        out["warning"] = f"[WARNING] {found}"
        lines.append(f"warning: {out['warning']}")
    if row.critical:
        state.action, state.action_class = row.quick_action_label, row.label
        out["quick_action"] = state.action
        lines.append(f"quick action presented (awaiting user confirmation): {state.action}")
    state.until[row.label] = now + round(row.cooldown_seconds * 1_000_000)


def answer(state: SessionState, row) -> dict:
    """Apply a user's answer to the pending quick action; a refused one changes nothing."""
    if row.action not in USER_ACTIONS:
        return {"error": UNKNOWN_ACTION}
    if state.action is None:
        return {"error": NONE_PENDING}
    out = {
        "class_name": state.action_class,
        "quick_action_label": state.action,
        "confirmed": row.action == "confirm",
        "note": ACTION_NOTES[row.action],
        "log": [f"t={_seconds(int(row.ts_us), 2)} {ACTION_LOGS[row.action] % (state.action_class, state.action)}"],
    }
    state.action = state.action_class = None
    return out
