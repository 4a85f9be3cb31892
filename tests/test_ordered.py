"""Order-dependent helpers on skewed keys: chunked scans equal plain windows, nothing is lost."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auricle.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in key 0, some without a key, many equal values."""
    return (
        spark.range(3000)
        .select(
            F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 17).alias("k"),
            "id",
            (F.col("id") * 7919 % 101).alias("v"),
            F.md5(F.col("id").cast("string")).alias("h"),
        )
        .repartition(5)
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_row_index_equals_row_number(skewed):
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.select("k", "id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    got = O.row_index(skewed, ["k"], ["v", "id"], "i").select("k", "id", "i", F.col("i_total").alias("n"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_chunked_equals_window(skewed, exclusive):
    specs = {
        "s": O.Running("sum", F.col("v"), exclusive=exclusive, total=True),
        "m": O.Running("max", F.struct("v", "id"), exclusive=exclusive),
        "x": O.Running("max", F.when(F.col("v") > 90, F.col("id")), exclusive=exclusive),
        "y": O.Running("last", F.when(F.col("v") % 9 == 4, F.struct("id")), exclusive=exclusive),
    }
    out = []
    for chunked in (False, True):
        o = O.OrderedRows.of(skewed, ["k"], ["v", "id"], chunked).running(**specs)
        o = o.running(t=O.Running("sum", F.coalesce("x", F.lit(1))))
        out.append(rows(o.result().select("k", "id", "s", "s_total", "m.v", "x", "t", F.col("y.id").alias("y"))))
    assert out[0] == out[1] and len(out[0]) == 3000


def test_split_hot_keeps_every_row(skewed):
    cold, hot = O.split_hot(skewed, ["k"], 500)
    assert hot.select("k").distinct().collect()[0][0] == 0
    assert cold.count() + hot.count() == 3000
    assert O.split_hot(skewed, ["k"], 5000)[1] is None


def test_per_key_mixes_both_paths(skewed):
    def scan(part):
        return part.running(s=O.Running("sum", F.col("v"))).result()

    assert rows(O.per_key(skewed, ["k"], ["id"], scan, 500).select("k", "id", "s")) == rows(
        O.per_key(skewed, ["k"], ["id"], scan).select("k", "id", "s")
    )


def test_hash_ordered_sum_equals_window(skewed):
    w = Window.partitionBy("k").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("k", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("c"), F.sum("v").over(Window.partitionBy("k")).alias("t"))
    got = O.hash_ordered_sum(skewed, ["k"], "h", ["id"], "v", "c").select("k", "id", "c", F.col("c_total").alias("t"))
    assert rows(got) == rows(want)


def test_exact_quantiles(skewed):
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    got = {r["k"]: r for r in O.exact_quantiles(skewed, ["k"], "v", probs).collect()}
    pdf = skewed.toPandas()
    for k, group in pdf.groupby("k", dropna=False):
        row = got[None if np.isnan(k) else int(k)]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(group["v"], p))
    overall = O.exact_quantiles(skewed, [], "v", probs).first()
    assert overall["q50"] == np.median(pdf["v"])


def test_quantiles_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert O.exact_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    one = spark.createDataFrame([(1, 2.5), (1, None)], "k int, v double")
    assert O.exact_quantiles(one, ["k"], "v", {"m": 0.5}).collect()[0]["m"] == 2.5


def test_top_n_and_first_row(skewed):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    want = skewed.withColumn("r", F.row_number().over(w)).filter("r <= 7").select("k", "id")
    assert rows(O.top_n(skewed, ["k"], [F.desc("v"), F.col("id")], 7, ["id"]).select("k", "id")) == rows(want)
    want = skewed.withColumn("r", F.row_number().over(w)).filter("r = 1").select("k", "id", "v", "h")
    got = O.first_row(skewed.withColumn("o", -F.col("v")), ["k"], ["o", "id"]).select("k", "id", "v", "h")
    assert rows(got) == rows(want)


def test_small_side_is_bounded(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(O.small_side(spark.range(10), 10))
    assert not hinted(O.small_side(spark.range(11), 10))
