"""The stream gives the same decisions as the batch scan; disorder is reported."""

import pytest
from pyspark.sql import functions as F

from auricle.operators import decisions as D
from auricle.plans.decisions import CLASSES, event_policies
from auricle.plans.fixtures import detections
from auricle.streaming.decisions import decision_stream
from auricle.streaming.windows import live_sliding_windows

SCHEMA = "session_id long, seq long, ts_us long, label string, confidence double"


def write_in_order(spark, rows, folder, parts):
    """One file per slice of time, written in time order."""
    bounds = rows.approxQuantile("ts_us", [i / parts for i in range(1, parts)], 0.0)
    edges = [-1, *map(int, bounds), 2**62]
    for lo, hi in zip(edges, edges[1:]):
        rows.filter((F.col("ts_us") > lo) & (F.col("ts_us") <= hi)).coalesce(1).write.mode("append").parquet(folder)


def run_stream(spark, df, tmp_path, name):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name)


def test_stream_equals_batch(spark, sf, tmp_path):
    det, pol = detections(spark, sf), event_policies(spark)
    folder = str(tmp_path / "events")
    write_in_order(spark, det, folder, 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_stream(spark, decision_stream(stream, pol, CLASSES), tmp_path, "decisions_out")
    assert got.filter("late").count() == 0
    want = D.decide(det, pol, CLASSES).orderBy("session_id", "ts_us", "seq").collect()
    rows = got.drop("late").orderBy("session_id", "ts_us", "seq").collect()
    assert [r.asDict() for r in rows] == [r.asDict() for r in want]


def test_user_actions_and_resets_in_the_stream(spark, sf, tmp_path):
    """The stream with answers equals the batch; after a reset a session decides as a new one would."""
    det, pol = detections(spark, sf), event_policies(spark)
    shift = F.when(F.col("seq") % 5 == 0, "snooze").when(F.col("seq") % 2 == 0, "confirm").otherwise("reject")
    acts = det.filter("seq % 3 = 1").select(
        "session_id", (F.col("seq") + 10**9).alias("seq"), (F.col("ts_us") + 100_000).alias("ts_us"), shift.alias("action")
    )
    folder = str(tmp_path / "acted")
    write_in_order(spark, det.unionByName(acts, allowMissingColumns=True), folder, 3)
    stream = spark.readStream.schema(f"{SCHEMA}, action string").option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_stream(spark, decision_stream(stream, pol, CLASSES), tmp_path, "acted_out")
    fields = ["session_id", "seq", "ts_us", "action", "class_name", "quick_action_label", "confirmed", "executed", "note", "error"]
    want = D.quick_action_results(det, pol, CLASSES, acts)
    rows = got.filter("action IS NOT NULL")
    assert sorted(map(str, rows.select(fields).collect())) == sorted(map(str, want.select(fields).collect()))
    logs = sorted(r.log[0] for r in rows.filter("log IS NOT NULL").collect())
    assert logs == sorted(r.log for r in want.filter("log IS NOT NULL").collect()) and logs
    decided = D.decide(det, pol, CLASSES, actions=acts)
    mine = got.filter("action IS NULL").select(decided.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, decided.collect()))

    folder = str(tmp_path / "reset")
    first = [(1, 1, 10**6, "error", 0.9, None), (1, 2, 2 * 10**6, None, None, "reset"), (1, 3, 3 * 10**6, "error", 0.9, None)]
    spark.createDataFrame(first, f"{SCHEMA}, action string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(f"{SCHEMA}, action string").parquet(folder)
    rows = run_stream(spark, decision_stream(stream, pol, CLASSES), tmp_path, "reset_out").orderBy("seq").collect()
    assert [r.quick_action for r in rows] == ["Call emergency contact", None, "Call emergency contact"]


def test_late_rows_are_marked(spark, tmp_path):
    pol = event_policies(spark)
    folder = str(tmp_path / "late")
    for batch in ([(1, 5, 5_000_000, "error", 0.9)], [(1, 2, 2_000_000, "error", 0.9), (1, 6, 6_000_000, "error", 0.9)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = run_stream(spark, decision_stream(stream, pol, CLASSES), tmp_path, "late_out").orderBy("seq").collect()
    assert [(r.seq, r.late, r.verification_state) for r in rows] == [(2, True, None), (5, False, "verified"), (6, False, "verified")]


def test_sliding_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "raw")
    events.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    got = run_stream(spark, live_sliding_windows(stream, "ts", "event_type", "value"), tmp_path, "windows_out")
    want = live_sliding_windows(events, "ts", "event_type", "value")
    # A window still open under the watermark when the input ends is not emitted.
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 1_000_000
    closed = want.filter(F.col("end_us") <= last)
    assert closed.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert got.count() > 1500


@pytest.mark.parametrize("batch", [True])
def test_each_event_falls_into_two_windows(spark, sf, batch):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = live_sliding_windows(events, "ts", "event_type", "value")
    assert out.agg(F.sum("n")).first()[0] == 2 * events.count()
