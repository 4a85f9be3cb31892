"""Decision semantics: hand-made sequences, scan = chunked scan = one-row-at-a-time stream."""

import pytest

from auricle.operators import decisions as D
from auricle.operators import policies as P
from auricle.params import AUDIO_MODES
from auricle.plans.decisions import CLASSES, event_policies
from auricle.plans.fixtures import detections
from auricle.streaming.transition import SessionState, advance

SAFETY, PLAIN = AUDIO_MODES[2], AUDIO_MODES[1]
NAMES = ("Siren", "Alarm", "Vehicle_Horn")


def table(spark, **entries):
    base = {"confirm_windows": 1, "release_seconds": 5.0, "cooldown_seconds": 0.0}
    return P.policy_table(spark, "Test", PLAIN, {n: {**base, **e} for n, e in entries.items()}, NAMES)


def run(spark, policies, sequence, actions=None, **kw):
    """sequence: (label, confidence, seconds)."""
    rows = [(1, i, round(t * 1e6), lab, conf) for i, (lab, conf, t) in enumerate(sequence)]
    det = spark.createDataFrame(rows, "session_id long, seq long, ts_us long, label string, confidence double")
    out = D.decide(det, policies, NAMES, actions=actions, **kw)
    return out.orderBy("ts_us", "seq").collect()


@pytest.fixture(params=[10**9, 1], ids=["window", "chunked"])
def limit(request):
    return {"max_rows": request.param}


def test_gate(spark, limit):
    pol = table(spark, Siren={"confidence_threshold": 0.8})
    rows = run(spark, pol, [("Siren", 0.8, 0), ("Siren", 0.79, 1), ("Alarm", 0.99, 2), ("Cat", 0.99, 3), (None, 0.0, 4)], **limit)
    assert [r.verified for r in rows] == [True, False, False, False, False]
    assert rows[1].reasons == ["confidence 0.79 below threshold 0.80 for 'Siren' - no action"]
    assert rows[2].reasons == ["detected class 'Alarm' is not enabled in profile 'Test' - no action"]
    assert rows[3].reasons == ["detected class 'Cat' is not a supported trigger class - no action"]
    assert rows[4].reasons == ["detected class None is not a supported trigger class - no action"]
    assert rows[4].detected_class is None and not rows[4].trigger_enabled


def test_persistence_and_interruption(spark, limit):
    pol = table(spark, Siren={"confirm_windows": 3}, Alarm={"confirm_windows": 3})
    rows = run(spark, pol, [("Siren", 0.9, i) for i in range(4)], **limit)
    assert [r.verification_state for r in rows] == ["pending", "pending", "verified", "verified"]
    assert rows[0].log == ["t=0.00 awaiting persistence 1/3 for 'Siren'"]
    assert [r.notification for r in rows] == [None, None, "Siren detected", None]
    rows = run(spark, pol, [("Siren", 0.9, 0), ("Siren", 0.9, 1), ("Alarm", 0.9, 2), ("Siren", 0.9, 3), ("Siren", 0.9, 4)], **limit)
    assert not any(r.verified for r in rows)
    rows = run(spark, pol, [("Siren", 0.9, 0), ("Siren", 0.9, 1), (None, 0.0, 2), ("Siren", 0.9, 3)], **limit)
    assert not any(r.verified for r in rows)


def test_modes_and_wording(spark, limit):
    pol = table(spark, Siren={"target_mode": SAFETY, "high_priority": True}, Vehicle_Horn={}, Alarm={"notify": False})
    rows = run(spark, pol, [("Siren", 0.9, 0), ("Vehicle_Horn", 0.9, 1), ("Alarm", 0.9, 2)], **limit)
    assert rows[0].audio_mode == SAFETY and rows[0].notification == f"Siren detected - {SAFETY} enabled"
    assert rows[0].warning == "[WARNING] Siren detected"
    assert rows[1].audio_mode == SAFETY and rows[1].notification == "Vehicle Horn detected"
    assert rows[2].notification is None and rows[2].verified


def test_release_at_exactly_the_limit(spark, limit):
    pol = table(spark, Siren={"target_mode": SAFETY})
    rows = run(spark, pol, [("Siren", 0.9, 0), (None, 0.0, 3), (None, 0.0, 5), (None, 0.0, 20)], **limit)
    assert [r.audio_mode for r in rows] == [SAFETY, SAFETY, PLAIN, PLAIN]
    assert [r.restored for r in rows] == [False, False, True, False]
    assert [r.release_remaining_seconds for r in rows] == [5.0, 2.0, None, None]
    assert [r.release_timer_active for r in rows] == [False, True, False, False]
    assert rows[2].log == ["t=5.00 trigger 'Siren' absent for 5.0s - preferred mode restored"]


def test_unverified_run_of_the_active_class_blocks_release(spark, limit):
    pol = table(spark, Siren={"confirm_windows": 2})
    seq = [("Siren", 0.9, 0), ("Siren", 0.9, 1), (None, 0.0, 2), ("Siren", 0.9, 10), (None, 0.0, 11)]
    rows = run(spark, pol, seq, **limit)
    assert [r.verification_state for r in rows] == ["pending", "verified", "idle", "pending", "released"]


def test_cooldown(spark, limit):
    pol = table(spark, Siren={"cooldown_seconds": 10.0, "release_seconds": 1.0})
    seq = [("Siren", 0.9, 0), (None, 0.0, 2), ("Siren", 0.9, 3), (None, 0.0, 9), ("Siren", 0.9, 10), (None, 0.0, 15), ("Siren", 0.9, 19.999999)]
    rows = run(spark, pol, seq, **limit)
    assert [r.notification is not None for r in rows] == [True, False, False, False, True, False, False]
    assert rows[2].reasons == ["response for 'Siren' suppressed by cooldown (duplicate alert)"]
    assert [r.cooldown_active for r in rows] == [True, True, True, True, True, True, True]
    assert rows[6].log == ["t=20.00 response suppressed by cooldown for 'Siren'"]


def action_rows(spark, *rows):
    return spark.createDataFrame(
        [(1, seq, round(t * 1e6), a) for seq, t, a in rows], "session_id long, seq long, ts_us long, action string"
    )


def test_quick_action(spark, limit):
    pol = table(spark, Siren={"critical": True, "quick_action_label": "Call", "release_seconds": 5.0}, Alarm={})
    seq = [("Siren", 0.9, 0), ("Alarm", 0.9, 1), (None, 0.0, 2), ("Siren", 0.9, 3), (None, 0.0, 9)]
    acts = action_rows(spark, (100, 1.5, "confirm"), (101, 1.6, "reject"), (102, 3.5, "reject"), (103, 9.5, "confirm"), (104, 9.6, "drop"))
    rows = run(spark, pol, seq, actions=acts, **limit)
    assert [r.quick_action for r in rows] == ["Call", None, None, "Call", None]
    assert [r.quick_action_pending for r in rows] == [True, True, False, True, False]
    det = spark.createDataFrame(
        [(1, i, round(t * 1e6), lab, c) for i, (lab, c, t) in enumerate(seq)],
        "session_id long, seq long, ts_us long, label string, confidence double",
    )
    out = D.quick_action_results(det, pol, NAMES, acts, **limit).orderBy("seq").collect()
    assert [r.confirmed for r in out] == [True, None, False, None, None]
    assert not any(r.executed for r in out)
    assert out[0].class_name == "Siren" and out[0].quick_action_label == "Call"
    assert out[0].log.startswith("t=1.50 quick action confirmed by user for 'Siren': Call")
    assert out[1].error == out[3].error == "no user-confirmed quick action is currently pending"
    assert out[4].error == "action must be 'confirm' or 'reject'"


def fold(spark, det, pol, classes):
    gated = D.gate(D.attach_policy(det, pol), classes).withColumn("gate_reason", D.gate_reason(classes))
    gated = gated.orderBy("session_id", "ts_us", "seq").collect()
    states, out = {}, []
    for row in gated:
        state = states.setdefault(row.session_id, SessionState(mode=row.preferred_mode))
        out.append((row.session_id, row.seq, advance(state, row)))
    return out


def test_scan_equals_fold_and_chunked_scan(spark, sf):
    det, pol = detections(spark, sf), event_policies(spark)
    want = fold(spark, det, pol, CLASSES)
    assert any(d["notification"] for _, _, d in want) and any(d["restored"] for _, _, d in want)
    assert any("suppressed" in " ".join(d["log"]) for _, _, d in want)
    for max_rows in (10**9, 20):
        got = D.decide(det, pol, CLASSES, max_rows=max_rows).orderBy("session_id", "ts_us", "seq").collect()
        assert [(r.session_id, r.seq, {k: r[k] for k in want[0][2]}) for r in got] == want


def test_long_cooldown_chains(spark):
    """Dense alternation with a short cooldown: many fires per session, hot and cold."""
    rows = [(1, i, i * 700_000, "Siren" if i % 2 else "Alarm", 0.9) for i in range(400)]
    det = spark.createDataFrame(rows, "session_id long, seq long, ts_us long, label string, confidence double")
    pol = table(spark, Siren={"cooldown_seconds": 5.0}, Alarm={"cooldown_seconds": 0.0})
    want = [d["notification"] for _, _, d in fold(spark, det, pol, NAMES)]
    for max_rows in (10**9, 10):
        got = D.decide(det, pol, NAMES, max_rows=max_rows).orderBy("seq").collect()
        assert [r.notification for r in got] == want
    assert sum(n is not None for n in want) > 200
