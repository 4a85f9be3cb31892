"""Sources and sinks."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from auricle.operators.checks import DataContractError
from auricle.session import ensure_checkpoint_dir
from auricle.sources import readers, sinks


@pytest.mark.parametrize("name", ["", "  ", ".", "..", "a/b", "a\\b", "a:b", "a?"])
def test_bad_run_names(name):
    with pytest.raises(ValueError):
        sinks.check_run_name(name)


def test_runs_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, str(tmp_path), " exp ", ["id"])
    with pytest.raises(AnalysisException):
        sinks.write_once(spark.range(9), str(tmp_path), "exp", ["id"])
    assert spark.read.parquet(str(tmp_path / "exp")).count() == 3


def test_reuse_by_fingerprint(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "cache")
    calls = []

    def build():
        calls.append(1)
        return df

    for want in (False, True):
        rows, reused = sinks.reuse_or_build(spark, path, sinks.dataset_fingerprint(df, "id"), build)
        assert reused is want and rows.count() == 10
    other = spark.range(11)
    assert sinks.reuse_or_build(spark, path, sinks.dataset_fingerprint(other, "id"), lambda: other)[1] is False
    assert len(calls) == 1


def test_fingerprints_ignore_order_and_see_changes(spark):
    a = sinks.dataset_fingerprint(spark.range(100), "id").first()
    assert sinks.dataset_fingerprint(spark.range(100).orderBy(F.desc("id")), "id").first() == a
    assert sinks.dataset_fingerprint(spark.range(1, 101), "id").first() != a
    five = spark.createDataFrame([(i, -i) for i in range(5)], "id int, at int")
    marks = {sinks.ordered_fingerprint(five, "id"), sinks.ordered_fingerprint(five, "id", ["at"])}
    assert len(marks) == 2 and {len(m) for m in marks} == {64}
    assert sinks.ordered_fingerprint(five.orderBy(F.desc("id")), "id") in marks


def test_fingerprint_sees_values_and_descriptor(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    prints = [sinks.dataset_fingerprint(d, "id", ["v"], made) for d in (a, b) for made in ("mean", "max")]
    assert len({p.first() for p in prints}) == 4
    path = str(tmp_path / "cache")
    assert sinks.reuse_or_build(spark, path, prints[0], lambda: a)[1] is False
    rows, reused = sinks.reuse_or_build(spark, path, prints[2], lambda: b)
    assert not reused and {r.v for r in rows.collect()} == {"x", "y"}
    assert sinks.reuse_or_build(spark, path, prints[0], lambda: b)[0].filter("v IS NULL").count() == 1


def test_array_length_is_checked(spark, tmp_path):
    path = str(tmp_path / "arrays")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, x array<float>").write.parquet(path)
    with pytest.raises(DataContractError, match="rows_of_wrong_length=1"):
        readers.read_arrays(spark, path, "x", 2, ["id"])


def test_ids_stay_text_in_csv(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    spark.createDataFrame([("007", "1.5")], "source_id string, duration string").write.csv(path, header=True)
    row = readers.read_csv(spark, path, "source_id string, duration double").first()
    assert (row["source_id"], row["duration"]) == ("007", 1.5)


def test_inventory_hashes_files(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.wav").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = readers.file_inventory(readers.read_files(spark, str(tmp_path))).collect()
    assert [(r["file_name"], r["size_bytes"], r["sha256"]) for r in rows] == [("a.wav", 3, hashlib.sha256(b"abc").hexdigest())]


def test_checkpoint_dir_is_set_once(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == first
