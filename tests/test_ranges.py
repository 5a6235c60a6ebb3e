"""Ranges of channels: whole values, the bytes that were read, filters, records of several files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.sources import ranges


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ranges.register(spark)
    path = tmp_path_factory.mktemp("waves")
    np.save(path / "long.npy", np.arange(100_000, dtype=np.float32))
    np.save(path / "square.npy", np.arange(12).reshape(3, 4))
    (path / "bad.npy").write_bytes(b"no array")
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(-2000, 2000, (1000, 2)), rng.integers(-2048, 2048, (1000, 3)), rng.integers(-128, 128, (1000, 1))
    (path / "r1a.dat").write_bytes(b"skip" + a.astype("<i2").tobytes())
    flat = b.ravel()
    pairs = flat.reshape(-1, 2) & 0xFFF
    packed = np.stack([pairs[:, 0] & 255, pairs[:, 0] >> 8 | pairs[:, 1] >> 8 << 4, pairs[:, 1] & 255], 1).astype(np.uint8)
    (path / "r1b.dat").write_bytes(packed.tobytes())
    (path / "r1c.dat").write_bytes((c + 128).astype(np.uint8).tobytes())
    lines = ["r1 6 100 1000", "# a remark", "r1a.dat 16+4 100(50)/mV 16 0 0 0 0 II,", "r1a.dat 16+4 10/mmHg 16 5 0 0 0 ABP,"]
    lines += [f"r1b.dat 212 200 12 0 0 0 0 B{i}" for i in range(3)] + ["r1c.dat 80 1 8 0"]
    (path / "r1.hea").write_text("\n".join(lines))
    (path / "r2.hea").write_text("r2 1 100 10\nnone.dat 16 1 16 0 0 0 0 II\n")
    (path / "r3.hea").write_text("r3 1 100 10\nr1a.dat 310 1 16 0 0 0 0 II\n")
    wanted = {"II": (a[:, 0] - 50) / 100, "ABP": (a[:, 1] - 5) / 10, "B0": b[:, 0] / 200, "B1": b[:, 1] / 200, "B2": b[:, 2] / 200, "ch5": c[:, 0].astype(float)}
    return str(path), wanted


def loaded(spark, folder, **options):
    return spark.read.format("wave_ranges").options(path=folder, **options).load()


def test_whole_channels(spark, folder):
    path, wanted = folder
    rows = loaded(spark, path, chunk=300).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.first):
        found.setdefault((r.record, r.channel), []).extend(r.samples)
    for name, values in wanted.items():
        assert np.allclose(found["r1", name], values)
    assert found["long", "long"] == list(range(100_000)) and found["square", "square"] == list(range(12))
    assert {(r.record, r.status) for r in rows if r.status != "perfect"} == {("bad", "value_err"), ("r2", "fileOrHeader_missing"), ("r3", "value_err")}


@pytest.mark.parametrize("start, stop", [(0, 1), (2.01, 5.53), (9.9, 50), (20, 30)])
def test_a_range_reads_its_bytes_alone(spark, folder, start, stop):
    path, wanted = folder
    rows = loaded(spark, path, start=start, stop=stop).where("record = 'r1'").collect()
    first, last = round(start * 100), min(1000, round(stop * 100))
    assert {r.channel for r in rows} == (set(wanted) if first < last else set())
    width = {"II": 4, "ABP": 4, "B0": 4.5, "B1": 4.5, "B2": 4.5, "ch5": 1}
    for r in rows:
        assert np.allclose(r.samples, wanted[r.channel][first:last]) and r.first == first
        assert abs(r.bytes - width[r.channel] * (last - first)) <= 6
    long_ = loaded(spark, f"{path}/long.npy", start=50_000, stop=50_010, fs=1).collect()
    assert [r.samples for r in long_] == [list(range(50_000, 50_010))] and long_[0].bytes == 40


def test_filters_prune_pieces(spark, folder):
    path, _ = folder
    df = loaded(spark, path, chunk=100).where("channel = 'II' and t >= 3 and t < 5.5")
    assert sorted(r.t for r in df.collect()) == [3, 4, 5] and df.rdd.getNumPartitions() == 3
    assert loaded(spark, path, chunk=100).where(F.col("channel").isin("II", "B1") & (F.col("bytes") > 0)).count() == 20
