"""Silence, profiles applied in mid-session, live windows and snapshots: hand-made cases, and stream = batch."""

import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, run_stream

from auricle.operators import decisions as D
from auricle.operators import policies as P
from auricle.operators.ordered import as_of
from auricle.params import AUDIO_MODES
from auricle.plans import sessions as S
from auricle.plans.decisions import CLASSES, event_policies
from auricle.plans.fixtures import detections
from auricle.streaming import decisions as live
from auricle.streaming.windows import window_detections

SAFETY, PLAIN = AUDIO_MODES[2], AUDIO_MODES[1]
NAMES = ("Siren", "Alarm")
SECOND = 10**6


def policy(spark, profile="Test", mode=PLAIN, **entries):
    base = {"confirm_windows": 1, "release_seconds": 5.0, "cooldown_seconds": 0.0}
    return P.policy_table(spark, profile, mode, {n: {**base, **e} for n, e in entries.items()}, NAMES)


def heard(spark, *rows):
    """(session, seconds, label)."""
    data = [(s, i, round(t * SECOND), label, 0.9) for i, (s, t, label) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def write_slices(rows, folder, edges):
    for lo, hi in zip([-1, *edges], [*edges, 2**62]):
        rows.filter((F.col("ts_us") > lo) & (F.col("ts_us") <= hi)).coalesce(1).write.mode("append").parquet(folder)


def edges_of(rows, parts):
    return [int(x) for x in rows.approxQuantile("ts_us", [i / parts for i in range(1, parts)], 0.0)]


def read_slices(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    a, b = (sorted(map(str, x.select(sorted(x.columns)).collect())) for x in (a, b))
    assert [x for x in a if x not in set(b)][:1] == [x for x in b if x not in set(a)][:1]
    assert a == b
    return len(a)


@pytest.fixture(params=[10**9, 1], ids=["window", "chunked"])
def limit(request):
    return {"max_rows": request.param}


def test_release_falls_into_a_silence(spark, limit):
    """Silence of 2 s, release after 5 s: the release is at the later of both ends, if nothing comes up to then."""
    pol = policy(spark, Siren={"target_mode": SAFETY})
    det = heard(
        spark,
        (1, 0, "Siren"), (1, 30, None),  # silent: released at 5 s, not at 30 s
        (2, 0, "Siren"), (2, 4, None), (2, 30, None),  # the silence ends at 6 s, after the release time
        (3, 0, "Siren"), (3, 5, "Siren"), (3, 9.5, None),  # a row at the moment itself: no silence there
        (4, 0, "Siren"), (4, 1, None), (4, 3, None), (4, 5, None), (4, 50, None),  # released by a row, once
        (5, 0, "Siren"),  # the end: known up to 20 s
    )
    out = D.decide(det, pol, NAMES, silence_us=2 * SECOND, until=20 * SECOND, **limit)
    rows = out.orderBy("session_id", "ts_us").collect()
    assert [(r.session_id, r.ts_us / SECOND) for r in rows if r.silent] == [(1, 5.0), (2, 6.0), (3, 11.5), (5, 5.0)]
    assert [(r.session_id, r.ts_us / SECOND) for r in rows if r.restored] == [(1, 5.0), (2, 6.0), (3, 11.5), (4, 5.0), (5, 5.0)]
    one = next(r for r in rows if r.silent)
    assert (one.seq, one.audio_mode, one.verification_state, one.detected_class) == (None, PLAIN, "released", None)
    assert one.log == ["t=5.00 trigger 'Siren' absent for 5.0s - preferred mode restored"]
    plain = D.decide(det, pol, NAMES, **limit)
    assert plain.count() == det.count() and "silent" not in plain.columns
    assert D.decide(det, pol, NAMES, silence_us=2 * SECOND, until=5 * SECOND, **limit).filter("silent AND session_id = 5").isEmpty()


def test_streak_ends_in_a_silence(spark, limit):
    pol = policy(spark, Siren={"confirm_windows": 2})
    det = heard(spark, (1, 0, "Siren"), (1, 3, "Siren"), (1, 5, "Siren"))
    out = D.decide(det, pol, NAMES, silence_us=2 * SECOND, **limit).orderBy("ts_us").collect()
    assert [r.verification_state for r in out] == ["pending", "pending", "verified"]
    with pytest.raises(ValueError):
        D.decide(det, pol, NAMES, silence_us=0)


def test_silence_clears_a_pending_action(spark, limit):
    pol = policy(spark, Siren={"critical": True, "quick_action_label": "Call"})
    det = heard(spark, (1, 0, "Siren"), (1, 30, None))
    acts = spark.createDataFrame([(1, 9, 10 * SECOND, "confirm")], "session_id long, seq long, ts_us long, action string")
    out = D.decide(det, pol, NAMES, actions=acts, silence_us=SECOND, **limit).orderBy("ts_us").collect()
    assert [(r.ts_us / SECOND, r.quick_action_pending) for r in out] == [(0, True), (5, False), (30, False)]


def test_silence_equals_the_chunked_scan(spark, sf):
    det, pol = detections(spark, sf), event_policies(spark)
    until = det.agg(F.max("ts_us")).first()[0]
    one, many = (D.decide(det, pol, CLASSES, silence_us=S.SILENCE_US, until=until, max_rows=n) for n in (10**9, 20))
    assert same(one, many) > det.count()


def test_silent_sessions_of_a_stream(spark, sf, tmp_path):
    """A timer releases what no later row does; until then the stream knows what its watermark says."""
    det, pol = detections(spark, sf), event_policies(spark)
    folder = str(tmp_path / "events")
    write_slices(det, folder, edges_of(det, 5))
    stream = live.decision_stream(read_slices(spark, folder, SCHEMA), pol, CLASSES, silence_us=S.SILENCE_US, lateness="1 hour")
    got = run_stream(spark, stream, tmp_path, "silent_out")
    until = det.agg(F.max("ts_us")).first()[0] // 1000 * 1000 - S.HOUR_US
    want = D.decide(det, pol, CLASSES, silence_us=S.SILENCE_US, until=until)
    assert got.filter("late").isEmpty()
    assert same(got.drop("late"), want) > det.count()
    whole = D.decide(det, pol, CLASSES, silence_us=S.SILENCE_US, until=2**60)
    assert whole.count() > want.count()  # some sessions stay open behind the watermark


@pytest.mark.parametrize("end, fired", [(15.0, []), (15.001, [15 * SECOND])])
def test_timer_fires_when_the_watermark_has_passed(spark, tmp_path, end, fired):
    """Session 1 falls silent; the watermark is moved by session 2 alone, to the moment and a millisecond on."""
    pol = policy(spark, Siren={"target_mode": SAFETY})
    folder = str(tmp_path / "moment")
    batches = [heard(spark, (1, 10, "Siren")), heard(spark, (2, end, None))]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    stream = live.decision_stream(read_slices(spark, folder, SCHEMA), pol, NAMES, silence_us=SECOND, lateness="0 seconds")
    got = run_stream(spark, stream, tmp_path, f"moment_{len(fired)}")
    assert [(r.session_id, r.ts_us, r.audio_mode) for r in got.filter("silent").collect()] == [(1, t, PLAIN) for t in fired]
    want = D.decide(batches[0].union(batches[1]), pol, NAMES, silence_us=SECOND, until=round(end * SECOND))
    assert same(got.drop("late"), want) == 2 + len(fired)


def test_as_of_takes_the_latest_row_not_later(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 5), ("a", None)], "k string, t long")
    right = spark.createDataFrame(
        [("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 7, 1, None), ("a", None, 1, "never"), (None, 1, 1, "n"), ("c", 1, 1, "c")],
        "k string, t long, tie int, v string",
    )
    for max_rows in (10**9, 1):
        out = as_of(left, right, ["k"], "t", ["v"], ["tie"], max_rows).collect()
        got = {(r.k, r.t): r.v for r in out}
        assert got == {("a", 1): None, ("a", 5): "y", ("a", 9): None, ("b", 5): None, (None, 5): "n", ("a", None): None}
    assert as_of(left.where("false"), right, ["k"], "t", ["v"]).isEmpty()
    assert as_of(left, right.where("false"), ["k"], "t", ["v"]).filter("v IS NOT NULL").isEmpty()


def profiles(spark):
    one = policy(spark, "Test", PLAIN, Siren={"target_mode": SAFETY, "cooldown_seconds": 100.0})
    return one.unionByName(policy(spark, "Night", AUDIO_MODES[0], Siren={"confirm_windows": 2}, Alarm={}))


def changes(spark, *rows):
    return spark.createDataFrame(rows, "session_id long, ts_us long, seq long, profile_name string")


def test_profile_is_applied_in_mid_session(spark, limit):
    det = heard(spark, (1, 0, "Siren"), (1, 1, "Alarm"), (1, 2, "Siren"), (1, 3, "Siren"), (1, 4, "Alarm"), (1, 6, "Siren"))
    turned = changes(spark, (1, 2 * SECOND, 1, "Night"), (1, 5 * SECOND, 2, "Test"), (1, 5 * SECOND, 3, "Test"), (2, 0, 1, "Night"))
    out = D.decide_under_profiles(det, turned, profiles(spark), "Test", NAMES, **limit).orderBy("ts_us").collect()
    assert [(r.epoch, r.profile_name) for r in out] == [(0, "Test")] * 2 + [(1, "Night")] * 3 + [(3, "Test")]
    # Alarm is not enabled at first; the streak starts afresh; the cooldown of the first epoch is forgotten.
    assert [r.verification_state for r in out] == ["verified", "idle", "pending", "verified", "verified", "verified"]
    assert [r.audio_mode for r in out] == [SAFETY, SAFETY, AUDIO_MODES[0], AUDIO_MODES[0], AUDIO_MODES[0], SAFETY]
    assert out[5].notification is not None and out[1].reasons[0].endswith("is not enabled in profile 'Test' - no action")


def test_silence_ends_with_its_epoch(spark, limit):
    det = heard(spark, (1, 0, "Siren"), (2, 0, "Siren"))
    turned = changes(spark, (1, 4 * SECOND, 1, "Night"), (2, 6 * SECOND, 1, "Night"))
    out = D.decide_under_profiles(det, turned, profiles(spark), "Test", NAMES, silence_us=SECOND, **limit)
    assert [(r.session_id, r.ts_us) for r in out.filter("silent").collect()] == [(2, 5 * SECOND)]


def test_profiles_as_a_second_stream(spark, sf, tmp_path):
    det, turned, pol = detections(spark, sf), S.profile_changes(spark, sf), S.all_policies(spark)
    # A change and a detection at one time: the change is in force, so it comes first.
    turned = turned.withColumn("seq", F.col("seq") - 10**9)
    edges = edges_of(det, 4)
    write_slices(det, str(tmp_path / "heard"), edges)
    write_slices(turned, str(tmp_path / "turned"), edges)
    own = pol.filter("profile_name = 'Events'")
    for silence in (None, S.SILENCE_US):
        rows = read_slices(spark, str(tmp_path / "heard"), SCHEMA)
        applied = live.profile_rows(read_slices(spark, str(tmp_path / "turned"), turned.schema), pol)
        stream = live.decision_stream(rows, own, CLASSES, silence, "1 hour", applied)
        got = run_stream(spark, stream, tmp_path, f"turned_{silence is None}")
        assert got.filter("action = 'apply'").count() == turned.count() and got.filter("late").isEmpty()
        until = det.agg(F.max("ts_us")).first()[0] // 1000 * 1000 - S.HOUR_US
        want = D.decide_under_profiles(det, turned, pol, "Events", CLASSES, silence_us=silence, until_us=until).drop("epoch")
        assert same(got.filter("action IS NULL").select(want.columns), want) >= det.count()


def test_snapshot_of_state_after_each_batch(spark, sf, tmp_path):
    """The state after every micro-batch is the batch query over the rows that came up to then."""
    det, pol = detections(spark, sf), event_policies(spark)
    folder, edges = str(tmp_path / "parts"), edges_of(det, 3)
    write_slices(det, folder, edges)
    run_stream(spark, live.decision_stream(read_slices(spark, folder, SCHEMA), pol, CLASSES), tmp_path, "parts_out")
    checkpoint = str(tmp_path / "parts_out-cp")
    for batch, edge in enumerate([*edges, 2**62]):
        want = D.session_snapshot(D.decide(det.filter(F.col("ts_us") <= edge), pol, CLASSES))
        got = live.snapshot_of_state(spark, checkpoint, batch)
        assert same(got.drop("silent"), want) == got.count()
    assert same(live.snapshot_of_state(spark, checkpoint).drop("silent"), want) > 10


def test_windows_feed_decisions_on_a_stream(spark, tmp_path):
    """Rows out of order within the lateness count, older ones do not; the decisions of stream and batch are equal."""
    pol = policy(spark, Siren={"confirm_windows": 2, "target_mode": SAFETY})
    schema = "user long, ts timestamp, label string, confidence double"

    def rows(*data):
        made = spark.createDataFrame(data, "user long, ms long, label string, confidence double")
        return made.select("user", F.timestamp_millis("ms").alias("ts"), "label", "confidence")

    first = [(1, 1000, "Siren", 0.9), (1, 1350, "Siren", 0.95), (2, 1360, None, 0.5), (1, 1150, "Alarm", 0.99), (2, 1150, "Siren", None)]
    second = [(1, 1250, "Siren", 0.97), (2, 1200, "Alarm", 0.9), (1, 3000, "Alarm", 0.8)]  # late, but within a second
    third = [(2, 5000, None, None)]
    fourth = [(1, 1000, "Alarm", 1.0), (1, 9000, None, None)]  # older than the watermark of the batch before, and the end
    folder = str(tmp_path / "sound")
    for data in (first, second, third, fourth):
        rows(*data).coalesce(1).write.mode("append").parquet(folder)
    stream = window_detections(read_slices(spark, folder, schema), "user", "ts", "label", "confidence")
    got = run_stream(spark, live.decision_stream(stream, pol, NAMES), tmp_path, "sound_out")
    table = rows(*first, *second, *third, (1, 9000, None, None))
    batch = window_detections(table, "user", "ts", "label", "confidence")
    closed = batch.filter(F.col("ts_us") <= 8_000_000)  # windows open behind the watermark are not given out
    assert same(got.drop("late"), D.decide(closed, pol, NAMES)) == closed.count()
    assert got.filter("late").isEmpty() and not got.filter("verified").isEmpty()


def test_stream_tells_nan_from_null(spark, tmp_path):
    """Rows of the state come typed: a confidence that is no number is above the threshold as in batch, a null is not."""
    det = heard(spark, (1, 0, "Siren"), (2, 0, "Siren"), (3, 0, "Siren"))
    odd = F.when(F.col("session_id") == 1, F.lit(float("nan"))).when(F.col("session_id") == 2, F.col("confidence"))
    det, pol = det.withColumn("confidence", odd), policy(spark, Siren={"confirm_windows": 1, "target_mode": SAFETY})
    det.coalesce(1).write.parquet(str(tmp_path / "odd"))
    got = run_stream(spark, live.decision_stream(read_slices(spark, str(tmp_path / "odd"), det.schema), pol, NAMES), tmp_path, "odd_out")
    rows = {r.session_id: r for r in got.collect()}
    assert rows[1].detected_confidence != rows[1].detected_confidence and rows[3].detected_confidence == 0.0
    assert [rows[i].verified for i in (1, 2, 3)] == [True, True, False]
    want = {r.session_id: r for r in D.decide(det, pol, NAMES).collect()}
    assert all(rows[i].reasons == want[i].reasons and rows[i].audio_mode == want[i].audio_mode for i in want)
