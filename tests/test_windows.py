"""Windows, spectra and scaling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import windows as op
from auricle.operators.checks import DataContractError
from auricle.params import PRESETS


def test_mel_power_equals_a_direct_transform():
    rng = np.random.default_rng(0)
    x, n_fft, hop = rng.normal(size=(3, 40)), 16, 8
    bands = op.mel_matrix(1600, n_fft, 5)
    got = op.mel_power(x, bands, n_fft, hop)
    taper = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / n_fft) for i in range(n_fft)])
    k, n = np.arange(n_fft // 2 + 1)[:, None], np.arange(n_fft)[None, :]
    dft = np.exp(-2j * np.pi * k * n / n_fft)
    for w in range(3):
        for f in range(op.sub_frames(40, n_fft, hop)):
            power = np.abs(dft @ (x[w, f * hop : f * hop + n_fft] * taper)) ** 2
            assert np.allclose(got[w, :, f], bands @ power)


def test_mel_bands_have_unit_area_and_rise():
    bands = op.mel_matrix(16000, 1024, 64)
    assert bands.shape == (64, 513) and (bands >= 0).all()
    centres = bands.argmax(axis=1)
    assert (np.diff(centres) >= 0).all()
    wide = bands[40:]
    assert np.allclose(wide.sum(axis=1) * 16000 / 1024, 1.0, atol=0.02)


def test_preset_frames():
    # Sub-frames of the presets.
    assert {p: op.sub_frames(w, n, h) for p, (w, _, n, h, _) in PRESETS.items()} == {"A": 5, "B": 30, "C": 22, "D": 14, "E": 61}


def test_mel_features_match_on_spark(spark):
    rng = np.random.default_rng(1)
    frames = rng.normal(size=(5, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(frames)], "id int, frame array<double>")
    out = op.mel_features(df, "frame", 1600, 16, 8, 4).orderBy("id").collect()
    want = op.mel_power(frames, op.mel_matrix(1600, 16, 4), 16, 8).reshape(5, -1)
    assert np.allclose([r["mel"] for r in out], want)


def test_windows_cover_only_whole_frames(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, list(range(3)))], "id int, samples array<int>")
    out = op.frame_windows(df, "samples", 4, 3).orderBy("id", "start_sample").collect()
    assert [(r["id"], r["start_sample"], r["frame"]) for r in out] == [(1, 0, [0, 1, 2, 3]), (1, 3, [3, 4, 5, 6]), (1, 6, [6, 7, 8, 9])]
    with pytest.raises(DataContractError, match="clips_shorter_than_a_window=1"):
        op.check_long_enough(df, "samples", 4)


def test_silent_windows_are_dropped_and_reported(spark):
    df = spark.createDataFrame([(1, [0.0] * 4 + [0.5] * 4), (2, [0.0] * 8)], "id int, samples array<double>")
    counts = op.window_counts(op.frame_windows(df, "samples", 4, 4), "frame", ["id"])
    assert sorted(map(tuple, counts.collect())) == [(1, 2, 1, 1), (2, 2, 2, 0)]
    with pytest.raises(DataContractError, match="clips_without_windows=1"):
        op.check_windows_left(counts)
    some = counts.filter("windows > 0")
    op.check_windows_left(some, df.filter("id = 1"), "id")
    with pytest.raises(DataContractError, match="clips_without_windows=1"):
        op.check_windows_left(some, df, "id")
    with pytest.raises(DataContractError, match="clips_shorter_than_a_window=1"):
        op.check_long_enough(spark.createDataFrame([(1, None)], "id int, samples array<double>"), "samples", 4)


def test_mono_is_the_mean_of_the_channels(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [3.0, 0.0, 1.0]],)], "c array<array<double>>")
    assert df.select(op.clean_waveform("c", 2)).first()[0] == [2.0, 1.0]


def test_bounds_come_from_train_only(spark):
    df = spark.createDataFrame([("train", [0.0, 2.0]), ("val", [-5.0, 9.0])], "split string, x array<double>")
    out = op.scale_clip01(df, "x", op.frozen_bounds(df, "x"))
    assert {r["split"]: r["x"] for r in out.collect()} == {"train": [0.0, 1.0], "val": [0.0, 1.0]}
    with pytest.raises(DataContractError, match="degenerate"):
        op.check_bounds(op.frozen_bounds(df.filter("split = 'val'"), "x"))
    flat = df.withColumn("x", F.array(F.lit(1.0)))
    with pytest.raises(DataContractError, match="degenerate"):
        op.check_bounds(op.frozen_bounds(flat, "x"))
