"""Text and array expressions."""

import random

from pyspark.sql import functions as F

from auricle.functions import columns as C
from auricle.functions import vectors as V


def test_fixed_rounds_like_the_exact_value(spark):
    rng = random.Random(3)
    values = [i / 1000 for i in range(0, 1001)] + [rng.random() for _ in range(2000)] + [0.125, 0.375, 2.5, 1.005, 12345.675]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r[1] for r in df.select("i", C.fixed("x", 2)).orderBy("i").collect()]
    assert got == [f"{x:.2f}" for x in values]


def test_fixed_micros(spark):
    values = [0, 4_999, 5_000, 5_001, 15_000, 25_000, 1_704_067_207_179_575, 86_400_000_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x long")
    got = [r[1] for r in df.select("i", C.fixed_micros("x", 2)).orderBy("i").collect()]
    assert got == ["0.00", "0.00", "0.00", "0.01", "0.02", "0.02", "1704067207.18", "86400.00"]


def test_label_set_and_blank(spark):
    df = spark.createDataFrame([(" Dog, cat ,,BIRD ", "  "), (None, "x")], "a string, b string")
    rows = df.select(C.label_set("a").alias("a"), C.blank_to_null("b").alias("b")).collect()
    assert rows[0]["a"] == ["dog", "cat", "bird"] and rows[0]["b"] is None
    assert rows[1]["a"] is None and rows[1]["b"] == "x"


def test_argmax_and_top_k_take_the_lowest_index_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4, 0.0],)], "p array<double>")
    names = F.array(*[F.lit(n) for n in "abcd"])
    row = df.select(V.argmax("p").alias("i"), V.top_k("p", names, 3).alias("k")).first()
    assert row["i"] == 1 and [(s["label"], s["p"]) for s in row["k"]] == [("b", 0.4), ("c", 0.4), ("a", 0.2)]


def test_signal_values(spark):
    df = spark.createDataFrame([([0.5, -1.0],), ([0.0, 0.0],)], "x array<float>")
    rows = df.select(V.rms("x").alias("r"), V.peak("x").alias("p")).collect()
    assert abs(rows[0]["r"] - (1.25 / 2) ** 0.5) < 1e-9 and rows[0]["p"] == 1.0 and rows[1]["r"] == 0.0
