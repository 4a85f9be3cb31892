"""Files read by ranges, manifests by header, durations from WAV headers."""

import base64
import hashlib
import io
import os
import struct
import subprocess
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import service
from auricle.operators.checks import DataContractError
from auricle.sources import files


def test_inventory_hashes_by_ranges(spark, tmp_path, monkeypatch):
    big = bytes(range(256)) * 5000
    for name, data in {"a.wav": big, "b.wav": b"", "c.txt": b"x", "d.WAV": b"y"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "e.flac").write_bytes(b"abc")
    rows = {r.file_name: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert {n: (r.size_bytes, r.sha256) for n, r in rows.items()} == {
        "a.wav": (len(big), hashlib.sha256(big).hexdigest()),
        "b.wav": (0, hashlib.sha256(b"").hexdigest()),
        "e.flac": (3, hashlib.sha256(b"abc").hexdigest()),
    }
    assert files.sha256_of(str(tmp_path / "a.wav"), chunk=1000) == rows["a.wav"].sha256
    assert all(r.error is None for r in rows.values())


def test_a_file_that_cannot_be_opened_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "list_files", lambda s, p, q: s.createDataFrame([(f"{p}/gone.wav", 3)], "path string, size_bytes long"))
    row = files.inventory(spark, str(tmp_path)).first()
    assert row.sha256 is None and "gone.wav" in row.error


def test_a_large_file_is_hashed_in_little_memory(tmp_path):
    """3 GB (a sparse file) under 100 MB above what the imports take."""
    path = tmp_path / "large.wav"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    code = (
        "import resource, sys; from auricle.sources.files import sha256_of\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        f"print(sha256_of({str(path)!r}), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300, check=True)
    digest, grown = out.stdout.split()[-2:]
    want = hashlib.sha256()
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    assert digest == want.hexdigest() and int(grown) < 100_000


ARRAYS = {
    "f4.npy": np.arange(24, dtype="<f4").reshape(6, 4),
    "column.npy": np.asfortranarray(np.arange(24, dtype=">f8").reshape(6, 4)),
    "cube.npy": np.arange(60, dtype="<i2").reshape(5, 3, 4),
    "column_cube.npy": np.asfortranarray(np.arange(60, dtype="<u4").reshape(5, 3, 4)),
    "flat.npy": np.arange(5, dtype="|u1"),
    "one.npy": np.float64(2.5),
    "none.npy": np.zeros((0, 3)),
    "thin.npy": np.zeros((2, 0)),
    "bool.npy": np.array([[True, False]]),
}


@pytest.mark.parametrize("range_bytes", [1, 40, 1 << 20])
def test_array_files_equal_their_arrays(spark, tmp_path, range_bytes):
    for name, a in ARRAYS.items():
        np.save(tmp_path / name, a)
    rows = files.read_array_files(spark, str(tmp_path), "double", range_bytes=range_bytes).collect()
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r.path), {})[r.row] = (r.shape, r.values)
    for name, a in ARRAYS.items():
        a = np.atleast_1d(a)
        want = {i: (list(a.shape[1:]), a[i].reshape(-1).astype(float).tolist()) for i in range(len(a))}
        assert got.get(name, {}) == want
    as_long = files.read_array_files(spark, str(tmp_path), "bigint", "cube.npy").filter("row = 4").first()
    assert as_long["values"] == ARRAYS["cube.npy"][4].ravel().tolist()


def test_a_large_array_is_read_in_parts(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(20_000, 50)).astype("<f4")
    np.save(tmp_path / "a.npy", a)
    rows = files.read_array_files(spark, str(tmp_path), range_bytes=1 << 18).withColumn("task", F.spark_partition_id())
    assert rows.count() == 20_000 and rows.select("task").distinct().count() > 1
    assert rows.agg(F.count_distinct("row")).first()[0] == 20_000
    total = rows.select(F.explode("values").alias("x")).agg(F.sum(F.col("x").cast("double"))).first()[0]
    assert total == pytest.approx(float(a.astype(float).sum()), rel=1e-9)
    begin, dtype, column_major, shape = files.array_header(str(tmp_path / "a.npy"))
    assert (files.read_rows(str(tmp_path / "a.npy"), begin, dtype, column_major, shape, 777, 779) == a[777:779]).all()


def test_what_is_no_array_is_an_error(spark, tmp_path):
    np.save(tmp_path / "text.npy", np.array(["a", "b"]))
    with pytest.raises(DataContractError, match="type"):
        files.array_header(str(tmp_path / "text.npy"))
    whole = io.BytesIO()
    np.save(whole, np.zeros((100, 10)))
    (tmp_path / "cut.npy").write_bytes(whole.getvalue()[:-8])
    with pytest.raises(DataContractError, match="ends before"):
        files.array_header(str(tmp_path / "cut.npy"))
    with pytest.raises(ValueError):
        files.read_array_files(spark, str(tmp_path), "text")


RENAMES = {"slice": "source_file", "class": "original_label"}
REQUIRED = ["source_dataset", "source_file"]


def test_a_thousand_manifests_of_three_headers_are_three_scans(spark, tmp_path):
    for i in range(1000):
        head, row = [
            ("source_dataset,slice,class", f'd,"f,{i}",00{i}'),
            ("﻿source_file,source_dataset,duration", f"f{i},e, {i}.5 "),
            ("extra,source_dataset,source_file", f"x,g,f{i}"),
        ][i % 3]
        (tmp_path / f"{i}_manifest.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "empty_manifest.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    out = files.read_manifests_found(
        spark, str(tmp_path), RENAMES, REQUIRED, ["original_label", "duration"], "*_manifest.csv", {"duration": "double"}
    )
    assert out.columns == [*REQUIRED, "original_label", "duration"] and out.count() == 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
    rows = {(r.source_dataset, r.source_file): r for r in out.collect()}
    assert rows["d", "f,3"].original_label == "003" and rows["e", "f4"].duration == 4.5 and rows["g", "f2"].duration is None


def test_manifests_without_required_columns_are_named(spark, tmp_path):
    (tmp_path / "good.csv").write_text("source_dataset,slice\nd,f\n")
    (tmp_path / "bad.csv").write_text("source_dataset,name\nd,f\n")
    with pytest.raises(DataContractError, match=r"1 manifests.*bad.csv: missing \['source_file'\]"):
        files.read_manifests_found(spark, str(tmp_path), RENAMES, REQUIRED, [])
    with pytest.raises(DataContractError, match="no manifests"):
        files.read_manifests_found(spark, str(tmp_path), RENAMES, REQUIRED, [], "*.tsv")


def wav(frames, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(bytes(frames * channels * width))
    return out.getvalue()


def chunk(name, data, size=None):
    return name + struct.pack("<I", len(data) if size is None else size) + data + b"\0" * (len(data) % 2)


FORM = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
HEAD = b"RIFF\0\0\0\0WAVE"
CASES = [
    (wav(8000, 8000), 1.0, None),
    (wav(12345, 44100, 2), 12345 / 44100, None),
    (wav(0, 8000), 0.0, None),
    (wav(30_000, 8000), 3.75, "file too long (limit 3s)"),
    (HEAD + chunk(b"LIST", b"abc") + chunk(b"fmt ", FORM + b"\0\0") + chunk(b"fact", b"") + chunk(b"data", bytes(4003)), 1000 / 8000, None),
    (HEAD + chunk(b"fmt ", FORM) + b"data" + struct.pack("<I", 4) + bytes(3), None, "invalid WAV file: truncated chunk"),
    (HEAD + chunk(b"data", bytes(8)) + chunk(b"fmt ", FORM), None, "invalid WAV file: no format chunk"),
    (HEAD + chunk(b"fmt ", FORM), None, "invalid WAV file: no data chunk"),
    (HEAD, None, "invalid WAV file: no data chunk"),
    (HEAD + b"fmt \1", None, "invalid WAV file: no data chunk"),
    (HEAD + chunk(b"fmt ", FORM[:14]) + chunk(b"data", bytes(8)), None, "invalid WAV file: broken format chunk"),
    (HEAD + chunk(b"fmt ", bytes(16)) + chunk(b"data", bytes(8)), None, "invalid WAV file: broken format chunk"),
    (HEAD + chunk(b"junk", b"", 2**32 - 1), None, "invalid WAV file: truncated chunk"),
    (HEAD + chunk(b"junk", b"") * 70 + chunk(b"fmt ", FORM) + chunk(b"data", b""), None, "invalid WAV file: too many chunks"),
    (b"RIFF\0\0\0\0WAVX" + chunk(b"fmt ", FORM), None, "invalid WAV file: missing WAVE signature"),
    (b"RIFF", None, "invalid WAV file: too short"),
    (wav(100_000, 8000), None, "file too large (limit 150000 bytes)"),
]


def test_durations_come_from_the_header(spark):
    rows = [(i, base64.b64encode(data).decode()) for i, (data, _, _) in enumerate(CASES)]
    rows += [(100, None), (101, ""), (102, "a=b="), (103, base64.b64encode(CASES[0][0]).decode()[1:])]
    table = spark.createDataFrame(rows, "id int, data string").withColumn("seconds", F.lit(9.0))
    got = {r.id: (r.seconds, r.reason) for r in service.screen_wav(table.drop("seconds"), "data", 150_000, 3).collect()}
    for i, (_, seconds, reason) in enumerate(CASES):
        assert got[i] == (seconds, reason), i
    assert [got[i][1] for i in (100, 101, 102)] == ["data is required", "data is required", "invalid base64 data"]
    assert got[103] == (None, "invalid base64 data")
