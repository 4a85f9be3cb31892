"""Live windows with the training overlap, over a stream or a table of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 200 ms windows with 50 % overlap.
WINDOW, STEP = "200 milliseconds", "100 milliseconds"


def live_sliding_windows(
    events: DataFrame, ts: str, label: str, confidence: str, lateness: str = "1 second", window: str = WINDOW, step: str = STEP
) -> DataFrame:
    """Detections and highest confidence per window and label.

    The watermark bounds the state of a stream and does nothing on a table; it needs a
    TIMESTAMP, so a timestamp without zone is cast (session time zone).
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", lateness)
    return (
        rows.groupBy(F.window("_ts", window, step).alias("w"), label)
        .agg(F.count(F.lit(1)).alias("n"), F.max(confidence).alias("max_confidence"))
        .select(
            F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), label, "n", "max_confidence"
        )
    )


def window_detections(
    events: DataFrame,
    session: str,
    ts: str,
    label: str,
    confidence: str,
    lateness: str = "1 second",
    window: str = WINDOW,
    step: str = STEP,
) -> DataFrame:
    """One detection per session and live window: the most confident label heard in it, the lower name on ties.

    Gives ``session_id, seq, ts_us, label, confidence`` for ``decide`` or ``decision_stream``: the time is the window's
    end, ``seq`` its number. Rows may come in any order; on a stream a window is given out once the watermark has
    passed its end, so decisions are never late, and rows older than the watermark are dropped. A row without label
    or confidence is heard as nothing.
    """
    heard = F.when(F.col(label).isNotNull() & F.col(confidence).isNotNull(), F.struct(-F.col(confidence), F.col(label).alias("label")))
    rows = events.select(F.col(session).alias("session_id"), F.col(ts).cast("timestamp").alias("_ts"), heard.alias("_heard"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", lateness)
    best = rows.groupBy("session_id", F.window("_ts", window, step).alias("w")).agg(F.min("_heard").alias("_best"))
    end, start = F.unix_micros("w.end"), F.unix_micros("w.start")
    return best.select(
        "session_id",
        (F.floor(start / F.lit(_micros(step)))).cast("bigint").alias("seq"),
        end.alias("ts_us"),
        F.col("_best.label").alias("label"),
        (-F.col("_best")["col1"]).alias("confidence"),
    )


def _micros(interval: str) -> int:
    """Microseconds of a fixed interval such as "100 milliseconds"."""
    number, unit = interval.split()
    return round(float(number) * {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 6 * 10**7}[unit.rstrip("s")])
