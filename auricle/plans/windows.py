"""Window and feature queries: 64-sample signals, windows of 16 samples every 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import checks
from ..operators import windows as op
from .fixtures import CLIPS_SQL, SIGNALS_SQL, clips, hash_split, hash_split_sql, signals
from .registry import query, table

W, S = 16, 8
FLOOR_DB = -19.0  # unit vectors of 64 samples have a level near -18 dB


def frames(spark, sf):
    return op.frame_windows(signals(spark, sf), "samples", W, S)


FRAMES_SQL = f"""(SELECT clip_id, class_id, start_sample, samples[start_sample + 1 : start_sample + {W}] AS frame
  FROM (SELECT *, unnest(range(0, len(samples) - {W} + 1, {S})) AS start_sample FROM {SIGNALS_SQL}))"""
LEVEL_SQL = f"20 * log10(sqrt(list_sum(list_transform(frame, lambda x: x::DOUBLE * x::DOUBLE)) / {W}) + 1e-12)"


@query(
    "clean_waveform",
    f"""SELECT clip_id, unnest(range(1, 41)) AS i, round(unnest(list_transform(range(1, 41), lambda k:
          (samples[k]::DOUBLE + samples[65 - k]::DOUBLE) / 2)), 9) AS x FROM {SIGNALS_SQL}""",
)
def clean_waveform(spark, sf):
    stereo = signals(spark, sf).select("clip_id", F.array("samples", F.reverse("samples")).alias("channels"))
    mono = stereo.select("clip_id", op.clean_waveform("channels", 40).alias("samples"))
    op.check_long_enough(mono, "samples", W)
    return mono.select("clip_id", F.posexplode("samples").alias("i", "x")).select(
        "clip_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 9).alias("x")
    )


@query(
    "frame_windows",
    f"""SELECT clip_id, class_id, CAST(start_sample AS INTEGER) AS start_sample,
          round(list_sum(list_transform(frame, lambda x: x::DOUBLE)), 6) + 0.0 AS total, frame[1] AS first, frame[{W}] AS last
        FROM {FRAMES_SQL}""",
)
def frame_windows(spark, sf):
    return frames(spark, sf).select(
        "clip_id",
        "class_id",
        "start_sample",
        F.round(v.total("frame"), 6).alias("total"),
        F.col("frame")[0].alias("first"),
        F.col("frame")[W - 1].alias("last"),
    )


@query(
    "window_energy_filter",
    f"""SELECT clip_id, count(*) AS raw_windows, count(*) FILTER (WHERE {LEVEL_SQL} <= {FLOOR_DB}) AS dropped_silent,
          count(*) FILTER (WHERE {LEVEL_SQL} > {FLOOR_DB}) AS windows FROM {FRAMES_SQL} GROUP BY clip_id""",
)
def window_energy_filter(spark, sf):
    return op.window_counts(frames(spark, sf), "frame", ["clip_id"], FLOOR_DB)


BANDS = op.mel_matrix(1600, 8, 4)


def dft_sql(wave: str) -> str:
    taper = "(0.5 - 0.5 * cos(2 * pi() * i / 8))"
    return f"list_sum(list_transform(range(8), lambda i: frame[4 * f + i + 1]::DOUBLE * {taper} * {wave}(2 * pi() * k * i / 8)))"


@query(
    "mel_features",
    f"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"({m}, {k}, {float(BANDS[m, k])!r}::DOUBLE)" for m in range(4) for k in range(5))}) AS t(m, k, weight)),
        s AS (SELECT clip_id, class_id, start_sample, frame, f, unnest(range(5)) AS k FROM (
              SELECT *, unnest(range(3)) AS f FROM {FRAMES_SQL} WHERE {LEVEL_SQL} > {FLOOR_DB})),
        p AS (SELECT clip_id, class_id, start_sample, f, k, {dft_sql("cos")} ** 2 + {dft_sql("sin")} ** 2 AS power FROM s)
        SELECT clip_id, class_id, CAST(start_sample AS INTEGER) AS start_sample, CAST(m * 3 + f AS INTEGER) AS pos,
          round(10 * log10(greatest(sum(weight * power), 1e-10)), 4) AS db
        FROM p JOIN b ON b.k = p.k GROUP BY ALL""",
)
def mel_features(spark, sf):
    kept = op.window_energy_filter(frames(spark, sf), "frame", FLOOR_DB)
    mel = op.mel_features(kept, "frame", sample_rate=1600, n_fft=8, hop=4, n_mels=4)
    return mel.select("clip_id", "class_id", "start_sample", F.posexplode(v.power_to_db("mel")).alias("pos", "db")).withColumn(
        "db", F.round("db", 4)
    )


@query(
    "power_to_db",
    f"""SELECT clip_id, round(list_min(db), 6) AS lo, round(list_max(db), 6) AS hi, round(list_sum(db), 5) AS total
        FROM (SELECT clip_id, list_transform(samples, lambda x: 10 * log10(greatest(x::DOUBLE * x::DOUBLE, 1e-10)) - 10 * log10(2.0::DOUBLE))
              AS db FROM {SIGNALS_SQL})""",
)
def power_to_db(spark, sf):
    power = F.transform("samples", lambda x: x.cast("double") * x.cast("double"))
    rows = signals(spark, sf).select("clip_id", v.power_to_db(power, ref=2.0).alias("db"))
    return rows.select(
        "clip_id",
        F.round(F.array_min("db"), 6).alias("lo"),
        F.round(F.array_max("db"), 6).alias("hi"),
        F.round(v.total("db"), 5).alias("total"),
    )


def split_signals(spark, sf):
    return signals(spark, sf).withColumn("split", hash_split("clip_id"))


SPLIT_SIGNALS_SQL = f"(SELECT *, {hash_split_sql('clip_id')} AS split FROM {SIGNALS_SQL})"
BOUNDS_SQL = f"""(SELECT min(list_min(samples))::DOUBLE AS lo, max(list_max(samples))::DOUBLE AS hi
  FROM {SPLIT_SIGNALS_SQL} WHERE split = 'train')"""


@query("frozen_bounds", f"SELECT lo, hi FROM {BOUNDS_SQL}")
def frozen_bounds(spark, sf):
    return op.frozen_bounds(split_signals(spark, sf), "samples")


@query(
    "scale_clip01",
    f"""SELECT clip_id, split, round(list_min(s), 6) AS lo, round(list_max(s), 6) AS hi, round(list_sum(s), 6) AS total
        FROM (SELECT clip_id, split, list_transform(samples, lambda x: least(greatest((x::DOUBLE - lo) / (hi - lo), 0), 1)) AS s
              FROM {SPLIT_SIGNALS_SQL}, {BOUNDS_SQL})""",
)
def scale_clip01(spark, sf):
    rows = split_signals(spark, sf)
    scaled = op.scale_clip01(rows, "samples", op.frozen_bounds(rows, "samples"))
    return scaled.select(
        "clip_id",
        "split",
        F.round(F.array_min("samples"), 6).alias("lo"),
        F.round(F.array_max("samples"), 6).alias("hi"),
        F.round(v.total("samples"), 6).alias("total"),
    )


@query(
    "window_index",
    f"""SELECT split, clip_id, CAST(start_sample AS INTEGER) AS start_sample,
          row_number() OVER (PARTITION BY split ORDER BY clip_id, start_sample) - 1 AS window_index
        FROM (SELECT *, {hash_split_sql('clip_id')} AS split FROM {FRAMES_SQL}) WHERE {LEVEL_SQL} > {FLOOR_DB}""",
)
def window_index(spark, sf):
    kept = op.window_energy_filter(frames(spark, sf), "frame", FLOOR_DB)
    rows = kept.select(hash_split("clip_id").alias("split"), "clip_id", "start_sample")
    return op.window_index(rows, "split", "clip_id", "start_sample")


@query(
    "window_split_summary",
    f"""SELECT split, count(DISTINCT clip_id) AS clips, count(*) FILTER (WHERE {LEVEL_SQL} > {FLOOR_DB}) AS windows,
          count(*) AS raw_windows, count(*) FILTER (WHERE {LEVEL_SQL} <= {FLOOR_DB}) AS dropped_silent
        FROM (SELECT *, {hash_split_sql('clip_id')} AS split FROM {FRAMES_SQL}) GROUP BY split""",
)
def window_split_summary(spark, sf):
    counts = op.window_counts(frames(spark, sf), "frame", ["clip_id"], FLOOR_DB)
    return op.window_split_summary(split_signals(spark, sf).drop("samples"), counts, "clip_id", "split")


@query(
    "clip_covariates",
    f"""SELECT clip_id, count(*) AS n_windows, round(avg(list_sum(list_transform(frame, lambda x: x::DOUBLE)) / {W}), 8) + 0.0
          AS feat_mean FROM {FRAMES_SQL} WHERE {LEVEL_SQL} > {FLOOR_DB} GROUP BY clip_id""",
)
def clip_covariates(spark, sf):
    kept = op.window_energy_filter(frames(spark, sf), "frame", FLOOR_DB)
    return op.clip_covariates(kept, "frame", "clip_id").withColumn("feat_mean", F.round("feat_mean", 8))


SMALL_PRESETS = {"A": (16, 8), "B": (32, 16), "C": (16, 16), "D": (24, 12), "E": (64, 32)}


@query(
    "multi_resolution_windows",
    f"""SELECT clip_id, preset, CAST(start_sample AS INTEGER) AS start_sample,
          round(list_sum(list_transform(samples[start_sample + 1 : start_sample + w], lambda x: x::DOUBLE)), 6) + 0.0 AS total
        FROM (SELECT *, unnest(range(0, len(samples) - w + 1, s)) AS start_sample FROM {SIGNALS_SQL},
              (VALUES {", ".join(f"('{p}', {w}, {s})" for p, (w, s) in SMALL_PRESETS.items())}) AS t(preset, w, s))""",
)
def multi_resolution_windows(spark, sf):
    rows = op.multi_resolution_windows(signals(spark, sf), "samples", SMALL_PRESETS)
    return rows.select("clip_id", "preset", "start_sample", F.round(v.total("frame"), 6).alias("total"))


@query(
    "one_to_one_join",
    f"""SELECT c.clip_id, c.project_class, o.o_totalprice FROM {CLIPS_SQL} c JOIN orders o ON c.clip_id = o.o_orderkey""",
)
def one_to_one_join(spark, sf):
    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), "o_totalprice")
    return checks.one_to_one_join(clips(spark, sf).select("clip_id", "project_class"), prices, ["clip_id"])
