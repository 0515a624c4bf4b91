"""Readers on tiny files of each format."""

import pytest
from pyspark.sql import functions as F

from obsengine.sources import formats


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stays_2012(spark, tmp_path):
    put(tmp_path, "132539.txt", "Time,Parameter,Value\n00:00,RecordID,132539\n00:00,Age,54\n00:00,Height,-1\n00:00,ICUType,4\n00:00,Weight,80.5\n00:07,HR,73\n49:00,HR,70\n")
    path = put(tmp_path, "132540.txt", "Time,Parameter,Value\n00:00,RecordID,132540\n00:00,Age,76\n")
    readings, statics = formats.read_stays_2012(spark, path)
    assert rows(readings) == [("132539", "HR", 7 / 60, 73.0), ("132539", "Weight", 0.0, 80.5)]
    assert rows(statics) == [("132539", "Age", 54.0), ("132539", "ICUType/surgical", 1.0), ("132540", "Age", 76.0)]


def test_stays_2019(spark, tmp_path):
    path = put(tmp_path, "p000001.psv", "HR|Temp|Age|ICULOS|SepsisLabel\nNaN|36.5|60|5|0\n88|NaN|60|6|1\n")
    put(tmp_path, "p000002.psv", "HR|Temp|Age|ICULOS|SepsisLabel\n1|1|1|1|0\n")
    readings, statics, units = formats.read_stays_2019(spark, path, excluded=["p000002"])
    assert rows(readings) == [("p000001", "HR", 6.0, 88.0), ("p000001", "Temp", 5.0, 36.5)]
    assert rows(statics) == [("p000001", "Age", 60.0)]
    assert rows(units) == [("p000001", 5.0, 7.0)]


def test_turbofan(spark, tmp_path):
    line = lambda e, c: f"{e} {c} " + " ".join(str(i) for i in range(24)) + "  \n"
    path = put(tmp_path, "train_FD001.txt", line(1, 1) + line(1, 2) + line(2, 1))
    readings, units = formats.read_turbofan(spark, path)
    assert readings.count() == 72
    assert rows(units) == [("FD001/1", 1.0, 3.0), ("FD001/2", 1.0, 2.0)]
    put(tmp_path, "train_FD002.txt", "1 1 2\n")
    with pytest.raises(Exception, match="26 fields"):
        formats.read_turbofan(spark, path)[0].collect()


def test_row_indexed(spark, tmp_path):
    path = put(tmp_path, "machine-1-1.txt", "1,2\n3,\n")
    assert rows(formats.read_row_indexed(spark, path)) == [("machine-1-1", "metric01", 0.0, 1.0), ("machine-1-1", "metric01", 1.0, 3.0), ("machine-1-1", "metric02", 0.0, 2.0)]


def test_testbed(spark, tmp_path):
    path = put(tmp_path, "7.csv", "datetime;Current;anomaly;changepoint\r\n2020-03-09 10:14:33;1.5;0.0;0.0\r\n2020-03-09 10:14:35;2.5;1.0;0.0\r\n")
    readings, units = formats.read_testbed(spark, path)
    assert rows(readings) == [("7", "Current", 0.0, 1.5), ("7", "Current", 2.0, 2.5)]
    assert rows(units) == [("7", 0.0, 3.0)]


def test_fragments(spark, tmp_path):
    path = put(tmp_path, "segments.csv", "channel,timestamp,value,label,sampling,anomaly,segment,train\nC1,2020-01-01T00:00:00Z,1.0,normal,5,0,1,1\nC1,2020-01-01T00:00:05Z,2.0,normal,5,0,1,1\nC2,2020-01-02T00:00:00Z,3.0,anomaly,1,1,2,0\n")
    readings, units = formats.read_fragments(spark, path)
    assert rows(readings) == [("1", "C1", 0.0, 1.0), ("1", "C1", 5.0, 2.0), ("2", "C2", 0.0, 3.0)]
    assert rows(units) == [("1", "training", 0.0, 10.0, 0), ("2", "test", 0.0, 1.0, 1)]


def test_process_runs(spark, tmp_path):
    spark.createDataFrame([(0.0, 1.0, 1, 5.0, 6.0), (0.0, 1.0, 2, 7.0, None)], "faultNumber double, simulationRun double, sample int, xmeas_1 double, xmv_1 double").write.parquet(str(tmp_path / "r"))
    readings, units = formats.read_process_runs(spark, str(tmp_path / "r"))
    assert rows(readings) == [("fault00-run001", "xmeas_1", 1.0, 5.0), ("fault00-run001", "xmeas_1", 2.0, 7.0), ("fault00-run001", "xmv_1", 1.0, 6.0)]
    assert rows(units) == [("fault00-run001", 1.0, 3.0)]


def test_icu(spark):
    patients = spark.createDataFrame([(1, 3000, 70.0), (2, 100, 60.0)], "stay long, discharge_minute long, weight double")
    charted = {"lab": spark.createDataFrame([(1, 5, "K", "4.1", 6), (1, 5, "K", "4.3", 9), (1, 7, "?", "1", 7), (2, 5, "K", "4", 5), (1, 8, "K", "> 9", 8)], "stay long, minute int, code string, value string, revised long")}
    codes = spark.createDataFrame([("lab", "K", "potassium")], "table string, code string, channel string")
    assert rows(formats.icu_readings(patients, charted, codes)) == [("1", "potassium", 5 / 60, 4.3), ("1", "weight", 0.0, 70.0)]


def test_turbines(spark, tmp_path):
    path = put(tmp_path, "T01.csv", "at,Wind (m/s),Wind (m/s) Max,Power (kW)\n2016-01-31 23:50:00,5,9,1\n2016-01-31 23:50:00,4,9,NaN\n2016-02-01 00:00:00,,9,2\n")
    out = formats.read_turbine_tables(spark, path, {"Wind": "m/s", "Power": "kW"}, "at", "2016-01-31 00:00:00")
    assert rows(out) == [("T01/2016-01", "Power", 23 + 50 / 60, 1.0), ("T01/2016-01", "Wind", 23 + 50 / 60, 4.0), ("T01/2016-02", "Power", 24.0, 2.0)]
    with pytest.raises(ValueError, match="Power"):
        formats.signal_columns(["Power (kW)"], {"Power": "MW"})


def test_water_quality(spark):
    data = [("a", "pH", float(i), 7.0, "u") for i in range(4)] + [("a", "pH", 0.0, 7.0, "u"), ("a", "pH", 9.0, 7.0, "v"), ("b", "pH", 0.0, 7.0, "u"), ("a", "rare", 0.0, 1.0, "u")]
    out = formats.water_quality(spark.createDataFrame(data, "location string, channel string, ts_hours double, value double, unit_code string"), F.lit(True), channels=1, least=3)
    assert rows(out) == [("a", "pH", float(i), 7.0) for i in range(4)]


def test_events_outcomes_parts(spark, tmp_path):
    for d in ("o", "l", "t"):
        (tmp_path / d).mkdir()
    o = put(tmp_path / "o", "o.csv", "RecordID,SAPS-I,In-hospital_death\n1,6,0\n2,,1\n")
    assert rows(formats.read_outcomes(spark, o)) == [("1", "In-hospital_death", 0.0), ("1", "SAPS-I", 6.0), ("2", "In-hospital_death", 1.0)]
    labels = put(tmp_path / "l", "l.csv", "ID,Channel,StartTime,EndTime\nid_1,c1,2004-12-01T00:00:00Z,2004-12-01T01:00:00Z\nid_2,c1,2004-12-02T00:00:00Z,2004-12-02T01:00:00Z\n")
    types = put(tmp_path / "t", "t.csv", "ID,Category\nid_1,Anomaly\n")
    assert rows(formats.read_events(spark, labels, types).select("event", "channel", "category")) == [("id_1", "c1", "Anomaly"), ("id_2", "c1", None)]
    df = spark.createDataFrame([("x", "1"), ("y", "1")], "part string, unit string")
    assert rows(formats.choose_parts(df, ["y"])) == [("y", "y/1")]
    with pytest.raises(ValueError, match="z"):
        formats.choose_parts(df, ["z"])


def test_raw_telemetry_by_month_and_thinned(spark):
    long = spark.sql("SELECT timestampadd(SECOND, 6 * id, timestamp_ntz'2024-01-31 23:59:30') AS ts, 'a' AS channel, cast(id AS double) AS value FROM range(10) UNION ALL SELECT timestamp_ntz'2024-03-01 00:00:00', 'b', 1.0D UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:00', 'z', 1.0D")
    origin = "2024-01-01 00:00:00"
    got = formats.telemetry_raw(long, ["a", "b"], origin, ["2024-03"])
    assert {r["unit"] for r in got.collect()} == {"2024-01", "2024-02"} and got.count() == 10
    thin = rows(formats.telemetry_raw(long, ["a", "b"], origin, [], cap=5))
    assert [r[0] for r in thin if r[1] == "b"] == ["2024-03"]
    assert 0 < len([r for r in thin if r[1] == "a"]) <= 5
