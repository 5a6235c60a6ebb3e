import numpy as np
from pyspark.sql import functions as F

from pulsemill.plans import workflow
from pulsemill.sources import tables, waves
from pulsemill.streaming import windows


def test_npy_and_listing(spark, tmp_path):
    np.save(tmp_path / "ecg.npy", np.arange(10.0))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    out = {r.channel: r for r in waves.read_npy(spark, str(tmp_path), chunk=100).collect()}
    assert out["ecg"].samples == list(range(10)) and out["ecg"].status == "perfect" and out["bad"].status == "value_err"
    assert waves.read_npy(spark, str(tmp_path), chunk=4).where("channel = 'ecg'").count() == 3
    assert {r.name for r in tables.list_files(spark, str(tmp_path), "*.npy").collect()} == {"ecg.npy", "bad.npy"}


def test_wfdb(spark, tmp_path):
    values = np.array([[100, -5], [200, 7], [-300, 2047]], np.int16)
    (tmp_path / "r1.hea").write_text("r1 2 125 3\nr1.dat 16 100(0)/mV 16 0 0 0 0 II,\nr1.dat 16 10/mmHg 16 0 0 0 0 ABP,\n")
    (tmp_path / "r1.dat").write_bytes(values.astype("<i2").tobytes())
    out = {r.channel: r for r in waves.read_wfdb(spark, str(tmp_path)).collect()}
    assert out["II"].samples == [1.0, 2.0, -3.0] and out["ABP"].samples == [-0.5, 0.7, 204.7] and out["II"].fs == 125
    (tmp_path / "r2.hea").write_text("r2 1 125 3\nr2.dat 80 10/mV 8 0 0 0 0 II,\n")
    (tmp_path / "r2.dat").write_bytes(b"abc")
    (tmp_path / "r3.hea").write_text("r3 1 125 3\nr3.dat 16 10/mV 16 0 0 0 0 II,\n")
    assert {(r.record, r.status) for r in waves.read_wfdb(spark, str(tmp_path)).collect()} == {("r1", "perfect"), ("r2", "value_err"), ("r3", "fileOrHeader_missing")}
    a, b = 5, -7  # two 12-bit values in three bytes
    packed = bytes([a & 255, (a >> 8 & 15) | ((b & 0xFFF) >> 8) << 4, b & 255])
    assert waves.decode_wfdb("x 1 100 2\nx.dat 212 1 12 0\n", packed)["ch0"][1].tolist() == [5.0, -7.0]


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,fin,v\n0,1,2.5\n1,2,x\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), "`Unnamed: 0` int, fin long, v double", skip_bad_lines=True)
    assert df.columns == ["fin", "v"] and df.collect()[0].v == 2.5
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() >= 1
    tables.write_text(df.select(F.to_json(F.struct("fin", "v")).alias("j")), "j", str(tmp_path / "txt"))
    assert tables.read_json(spark, str(tmp_path / "txt")).count() >= 1
    assert tables.ingest(spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "v double")).where("v is null").count() == 2
    meta = spark.createDataFrame([('{"time_origin": "2024-01-02 03:04:05.123+000"}',)], "m string")
    assert str(meta.select(waves.attribute_time("m")).first()[0]) == "2024-01-02 03:04:05.123000"


def test_sticky_stream_matches_batch(spark, tmp_path):
    rows = [(1, s, n) for s, n in enumerate([9, 8, 2, 9])] + [(2, s, 9) for s in range(3)]
    spark.createDataFrame(rows, "fin long, segment long, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fin long, segment long, n long").parquet(str(tmp_path / "in"))
    out = windows.run_once(windows.sticky_drop(stream, 5), str(tmp_path / "work"), mode="append")
    assert {(r.fin, r.segment): r.valid for r in out.collect()} == {(f, s): f == 2 or s < 2 for f, s, _ in rows}


def test_workflow(spark):
    rng = np.random.default_rng(0)
    rows = [(fin, "ecg", 1000 - s * 10 - i, float(rng.normal(fin % 2 * 5, 1))) for fin in range(20) for s in range(3) for i in range(1, 9)]
    samples = spark.createDataFrame(rows, "fin long, channel string, t long, value double")
    onset = spark.createDataFrame([(fin, 1000) for fin in range(20)], "fin long, onset long")
    features = workflow.segment_features(samples, onset, 10, 3, ["ecg"]).cache()
    assert features.count() == 60 and workflow.audit(features).first().encounters == 20
    columns = [c for c in features.columns if c.startswith("ecg_")]
    cleaned, kept = workflow.clean_features(features, columns)
    assigned, names = workflow.phenotypes(cleaned, kept, k=2, reducer="none", resamples=3)
    assert assigned.count() == 20 and names
    assert workflow.report(assigned, names).count() == assigned.select("cluster").distinct().count()


def test_export(spark, tmp_path):
    from pulsemill.operators import reports

    df = spark.createDataFrame([("a", 3, 0.5, 2.0)], "g string, n long, rate double, stay double")
    report = reports.validation_report(df, "g", "n", {"mortality": "rate"}, {"stay": "stay"})
    assert report.first().line == "a: 3 patients; mortality 50.0%; stay 2.0"
    reports.export({"groups": df}, {"report": report}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "groups/parquet")).count() == 1 and spark.read.text(str(tmp_path / "report/text")).count() == 1
    assert "2,174 encounters" in reports.methods_text(2174, 272, 4, 0.85, 0.01, 100)
