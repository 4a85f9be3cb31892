"""Overlapping windows over sample arrays and their features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..params import SILENT_DBFS
from .checks import DataContractError, require_zero
from .ordered import row_index


def clean_waveform(channels: str, max_samples: int) -> Column:
    """Mean over the channel arrays, cut to the first ``max_samples``."""
    c = F.col(channels)
    n = F.size(c)
    mono = F.transform(
        c[0],
        lambda _, i: F.aggregate(c, F.lit(0.0), lambda acc, ch: acc + F.get(ch, i).cast("double")) / n,
    )
    return F.slice(mono, 1, max_samples)


def check_long_enough(df: DataFrame, samples: str, window: int) -> None:
    """No clip may be shorter than one window."""
    require_zero(
        df.agg(
            F.count_if(F.col(samples).isNull() | (F.size(samples) < window)).alias("clips_shorter_than_a_window")
        ),
        "cleaned waveforms",
    )


def frame_windows(df: DataFrame, samples: str, window: Column | int, step: Column | int, name: str = "frame"):
    """One row per window start 0, step, 2 step, ... that fits; the clip's array leaves the row."""
    window = F.lit(window) if isinstance(window, int) else window
    step = F.lit(step) if isinstance(step, int) else step
    last = F.size(samples) - window
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, step))
    # Cut inside the row first: the clip's whole array is never repeated per window.
    cut = F.transform(
        starts, lambda s: F.struct(s.alias("start_sample"), F.slice(F.col(samples), s + 1, window).alias(name))
    )
    keep = [c for c in df.columns if c != samples]
    return df.select(*keep, F.explode(cut).alias("_w")).select(*keep, "_w.*")


def window_level(frame: str) -> Column:
    """Window level in dBFS."""
    return 20.0 * F.log10(v.rms(frame) + 1e-12)


def window_energy_filter(windows: DataFrame, frame: str, floor_db: float = SILENT_DBFS) -> DataFrame:
    return windows.filter(window_level(frame) > floor_db)


def window_counts(windows: DataFrame, frame: str, keys, floor_db: float = SILENT_DBFS) -> DataFrame:
    """Raw, dropped and kept windows per key."""
    return (
        windows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("raw_windows"),
            F.count_if(window_level(frame) <= floor_db).alias("dropped_silent"),
        )
        .withColumn("windows", F.col("raw_windows") - F.col("dropped_silent"))
    )


def check_windows_left(counts: DataFrame, clips: DataFrame | None = None, key: str | None = None) -> None:
    """No clip may be without windows; with the table of ``clips``, those that gave no window row count too."""
    if clips is not None:
        counts = clips.select(key).distinct().join(counts, key, "left").fillna(0, ["windows"])
    require_zero(counts.agg(F.count_if(F.col("windows") == 0).alias("clips_without_windows")), "window energy filter")


WINDOWS_AT_ONCE = 256


def mel_matrix(sample_rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular mel bands (linear below 1 kHz, logarithmic above), each of unit area in Hz."""
    # The scale is linear (200/3 Hz per mel) up to 1 kHz, then log with 27 steps to 6.4 kHz.
    per_mel, knee, log_step = 200.0 / 3.0, 1000.0, np.log(6.4) / 27.0

    def to_mel(hz):
        return hz / per_mel if hz < knee else knee / per_mel + np.log(hz / knee) / log_step

    def to_hz(mel):
        above = knee * np.exp(log_step * (mel - knee / per_mel))
        return np.where(mel < knee / per_mel, mel * per_mel, above)

    edges = to_hz(np.linspace(0.0, to_mel(sample_rate / 2.0), n_mels + 2))
    bins = np.linspace(0.0, sample_rate / 2.0, n_fft // 2 + 1)
    lower, centre, upper = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise = (bins - lower) / (centre - lower)
    fall = (upper - bins) / (upper - centre)
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (upper - lower))


def mel_power(frames: np.ndarray, bands: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """(windows, samples) -> (windows, bands, sub-frames) mel power."""
    taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)
    sub = np.lib.stride_tricks.sliding_window_view(frames, n_fft, axis=1)[:, ::hop]
    spectrum = np.fft.rfft(sub * taper, axis=2)
    power = spectrum.real**2 + spectrum.imag**2
    return (power @ bands.T).swapaxes(1, 2)


def mel_features(
    windows: DataFrame, frame: str, sample_rate: int, n_fft: int, hop: int, n_mels: int, name: str = "mel"
) -> DataFrame:
    """Mel power per window, flattened row-major (band, sub-frame); Arrow batches, no shuffle.

    Windows are transformed some hundred at a time, so that spectra of a batch are never all in memory.
    """
    keep = [c for c in windows.columns if c != frame]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = mel_matrix(sample_rate, n_fft, n_mels)
        for pdf in parts:
            for i in range(0, len(pdf), WINDOWS_AT_ONCE):
                some = pdf.iloc[i : i + WINDOWS_AT_ONCE]
                power = mel_power(np.stack(some[frame].to_numpy()).astype(np.float64), bands, n_fft, hop)
                yield some[keep].assign(**{name: list(power.reshape(len(some), -1))})

    schema = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in keep)
    return windows.mapInPandas(batches, f"{schema}, {name} array<double>")


def frozen_bounds(df: DataFrame, values: str, split: str = "split") -> DataFrame:
    """One row with the smallest and largest value of the train rows."""
    return df.filter(F.col(split) == "train").agg(
        F.min(F.array_min(values)).cast("double").alias("lo"), F.max(F.array_max(values)).cast("double").alias("hi")
    )


def check_bounds(bounds: DataFrame) -> tuple[float, float]:
    row = bounds.first()
    if row["lo"] is None or not np.isfinite([row["lo"], row["hi"]]).all() or row["hi"] <= row["lo"]:
        raise DataContractError(f"degenerate train range [{row['lo']}, {row['hi']}]")
    return row["lo"], row["hi"]


def scale_clip01(df: DataFrame, values: str, bounds: DataFrame) -> DataFrame:
    """Scale every split with the train bounds; values outside the range are clipped."""
    lo, hi = check_bounds(bounds)
    return df.withColumn(values, v.rescale01(values, F.lit(lo), F.lit(hi)))


def window_index(windows: DataFrame, split: str, clip: str, start: str) -> DataFrame:
    """Dense 0-based index per split in (clip, start) order, exact for a split of any size."""
    return row_index(windows, [split], [clip, start], "window_index").drop("window_index_total")


def window_split_summary(clips: DataFrame, counts: DataFrame, clip: str, split: str) -> DataFrame:
    """Clips, kept, raw and dropped windows per split."""
    return (
        clips.join(counts, clip)
        .groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("clips"),
            F.sum("windows").alias("windows"),
            F.sum("raw_windows").alias("raw_windows"),
            F.sum("dropped_silent").alias("dropped_silent"),
        )
    )


def clip_covariates(windows: DataFrame, values: str, clip: str) -> DataFrame:
    """Mean over the window means, and the number of windows, of each clip."""
    return windows.groupBy(clip).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg(v.mean(values)).alias("feat_mean")
    )


def multi_resolution_windows(df: DataFrame, samples: str, presets: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The windows of every preset (name -> (window, step)) of each clip."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("preset"), F.lit(w).alias("window"), F.lit(s).alias("step"))
            for n, (w, s) in presets.items()
        ]
    )
    spread = df.withColumn("_p", F.explode(rows)).select(*df.columns, "_p.*")
    return frame_windows(spread, samples, F.col("window"), F.col("step"))


def sub_frames(window: int, n_fft: int, hop: int) -> int:
    return 1 + (window - n_fft) // hop
