"""Departures by bins, local clocks, atomic publishing, late readings, window variants and a fit over corpora."""

import datetime as dt
import random
import statistics
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import detect, layouts, learners, windows
from obsengine.sources import formats
from obsengine.sources.tables import local_to_utc
from obsengine.streaming import late, readings as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_departures_by_bins_against_loops(spark):
    rng = random.Random(3)
    told = [(u, p, c, (b + 0.5) / 3, float(rng.randrange(20))) for u in "ab" for p in range(12) for c in ("x", "y") for b in range(3) for _ in range(rng.randrange(3)) if not (c == "y" and p in (4, 5, 6))]
    bins = detect.bin_summaries(spark.createDataFrame(told, "unit string, position int, channel string, time double, value double"), 3)
    floor = detect.departure_floor(bins)
    least = {(r["channel"], r["kind"]): r["floor"] for r in floor.collect()}
    held = {}
    for r in bins.collect():
        held.setdefault((r["unit"], r["position"], r["channel"]), []).append(r)
    want = []
    for (u, p, c), now in held.items():
        before = [held[u, q, c] for q in range(p - 4, p) if (u, q, c) in held]
        best = 0.0
        for k in detect.VALUES if len(before) >= 2 else ():
            h = [b[k] for w in before for b in w]
            mid = statistics.median(h)
            scale = max(1.4826 * statistics.median(abs(v - mid) for v in h), least[c, k])
            best = max(best, *[abs(b[k] - mid) / scale for b in now])
        want.append((u, p, c, best))
    got = rows(detect.bin_departures(bins, floor, 5))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def test_a_window_counts_once_in_its_history_however_many_bins_it_holds(spark):
    told = [("u", 0, "x", b / 4, 1.0) for b in range(4)] + [("u", 4, "x", 0.0, 9.0)]
    bins = detect.bin_summaries(spark.createDataFrame(told, "unit string, position int, channel string, time double, value double"), 4)
    assert rows(detect.bin_departures(bins, detect.departure_floor(bins), 6)) == [("u", 0, "x", 0.0), ("u", 4, "x", 0.0)]


def clocks(spark, name):
    """The zone's changes of 2024, minute by minute from the standard library."""
    zone, at, out = ZoneInfo(name), dt.datetime(2023, 12, 31, tzinfo=dt.UTC), []
    while at.year < 2025:
        minutes = int(at.astimezone(zone).utcoffset().total_seconds() // 60)
        if not out or out[-1][2] != minutes:
            out.append((name, None if not out else at.replace(tzinfo=None), minutes))
        at += dt.timedelta(minutes=30)
    return out


def test_local_clocks_at_both_changes_of_a_year(spark):
    names = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata"]
    table = spark.createDataFrame([r for n in names for r in clocks(spark, n)], "zone string, since timestamp_ntz, minutes int")
    told, want = [], {}
    for n in names:
        for _, since, minutes in [*clocks(spark, n)[1:], (n, dt.datetime(2024, 6, 1), 0)]:
            for off in range(-180, 181, 10):
                local = since + dt.timedelta(minutes=minutes + off, seconds=30)
                told.append((len(told), f" {n.lower()}", local))
                utc = local.replace(tzinfo=ZoneInfo(n)).astimezone(dt.UTC).replace(tzinfo=None, second=0)
                want[len(told) - 1] = (utc - dt.datetime(2024, 1, 1)).total_seconds() / 3600
    got = local_to_utc(spark.createDataFrame(told, "id int, zone string, clock timestamp_ntz"), "clock", "zone", table)
    assert got.columns == ["id", "zone", "clock", "time"]
    found = {r["id"]: r["time"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_local_clocks_without_a_known_zone_are_utc(spark):
    table = spark.createDataFrame([("X", dt.datetime(2024, 1, 2), 60)], "zone string, since timestamp_ntz, minutes int")
    told = spark.createDataFrame([(1, "?", dt.datetime(2024, 1, 1, 5)), (2, None, dt.datetime(2023, 12, 31, 23, 59, 59)), (3, "x", dt.datetime(2024, 1, 1, 2)), (4, "x", None)], "id int, zone string, clock timestamp_ntz")
    assert rows(local_to_utc(told, "clock", "zone", table).select("id", "time"))[:3] == [(1, 5.0), (2, -1 / 60), (3, 1.0)]
    assert local_to_utc(told, "clock", "zone", table).where("id = 4").first()["time"] is None
    assert local_to_utc(told, "clock", "zone", table.limit(0)).count() == 4


TOKENS = [("u1", 0, "a", 1.0, 0.1, "p"), ("u1", 1, "a", 2.0, 0.1, "p"), ("u2", 0, "b", 3.0, 0.2, "q")]


def tokens_of(spark, told=TOKENS):
    return spark.createDataFrame(told, "unit string, position int, channel string, value double, time double, part string")


def test_publish_twice_is_once(spark, tmp_path):
    path = formats.publish(tokens_of(spark), str(tmp_path), {"length": 24})
    written = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
    assert formats.publish(tokens_of(spark, TOKENS[::-1]).repartition(3), str(tmp_path), {"length": 24}) == path
    assert sorted(str(f) for f in tmp_path.rglob("*.parquet")) == written
    assert formats.publish(tokens_of(spark), str(tmp_path), {"length": 12}) != path
    assert formats.publish(tokens_of(spark, TOKENS[:2]), str(tmp_path), {"length": 24}) != path
    assert rows(formats.read_published(spark, path).select("unit", "position", "channel", "value", "time", "part")) == sorted(TOKENS)


def test_a_publish_that_died_is_not_read_and_not_in_the_way(spark, tmp_path, monkeypatch):
    frames = spark.createDataFrame
    source = tokens_of(spark)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError, match="lost"):
        formats.publish(source, str(tmp_path), {"length": 24})
    monkeypatch.setattr(spark, "createDataFrame", frames)
    (left,) = tmp_path.iterdir()
    assert list(left.rglob("*.parquet"))
    with pytest.raises(ValueError, match="nothing is published"):
        formats.read_published(spark, str(left))
    assert formats.publish(source, str(tmp_path), {"length": 24}) == str(left)
    assert formats.read_published(spark, str(left)).count() == 3


SCHEMA = "unit string, channel string, ts timestamp, value double"


def replay(spark, source, at, transform, files=1):
    out = transform(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(f"{at}/out")


@pytest.mark.parametrize(("length", "stride"), [(3600, 3600), (3600, 1500)])
def test_late_readings_are_counted_over_a_restart(spark, tmp_path, length, stride):
    rng, began = random.Random(1), dt.datetime(2024, 1, 1)
    batches = []
    for i in range(4):
        batches.append([(f"u{rng.randrange(2)}", "c", began + dt.timedelta(minutes=90 * i + rng.randrange(-200 if i else 0, 90), seconds=rng.randrange(60)), float(rng.randrange(50))) for _ in range(120)])
    batches.append([(f"u{k}", "c", began + dt.timedelta(days=3), -1.0) for k in range(2)])  # closes what is open
    found = None
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = replay(spark, str(tmp_path / "in"), tmp_path, lambda d: late.counted_windows(d, length, stride, 600))
    clock, held, gone = {}, {}, {}
    for batch in batches:
        closed = {u: t - 600 for u, t in clock.items()}
        for u, _, ts, v in batch:
            t = (ts - dt.datetime(1970, 1, 1)).total_seconds()
            clock[u] = max(clock.get(u, t), t)
            starts = [s for s in (t // stride * stride - k * stride for k in range(3)) if s <= t < s + length]
            if t // stride * stride + length <= closed.get(u, float("-inf")):
                gone[u] = gone.get(u, 0) + 1
                continue
            for s in starts:
                if s + length > closed.get(u, float("-inf")):
                    held.setdefault((u, s), []).append((t, v))
    given = {k: x for k, x in held.items() if k[1] + length <= clock[k[0]] - 600}
    epoch = F.unix_micros("win_start") / 1e6
    got = found.where("win_start IS NOT NULL").select("unit", epoch.alias("s"), "n", "mean", "minimum", "maximum", "last")
    assert sum(gone.values()) > 0
    assert rows(got) == sorted((u, s, len(x), sum(v for _, v in x) / len(x), min(v for _, v in x), max(v for _, v in x), max(x)[1]) for (u, s), x in given.items())
    assert rows(found.where("win_start IS NULL").groupBy("unit").agg(F.sum("late"))) == sorted(gone.items())
    if length == stride:
        assert sum(len(x) for x in given.values()) + sum(gone.values()) + 2 == sum(map(len, batches))


def test_stream_cleans_before_it_normalises(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("u", "a", at, 1e6), ("u", "a", at, 50.0), ("u", "a", at, 12.0), ("u", "b", at, 7.0)], SCHEMA).write.parquet(str(tmp_path / "in"))
    bounds = spark.createDataFrame([("a", 0.0, 5.0, 20.0, 100.0)], "channel string, removed_below double, clipped_below double, clipped_above double, removed_above double")
    stats = spark.createDataFrame([("a", 10.0, 2.0), ("b", 5.0, 0.0)], "channel string, mean double, std double")
    got = replay(spark, str(tmp_path / "in"), tmp_path, lambda d: stream.stream_clean_normalise(d, stats, bounds))
    assert sorted(r["value"] for r in got.collect()) == [1.0, 2.0, 5.0]


def test_window_variants_equal_assigned_windows(spark):
    rng = random.Random(5)
    obs = spark.createDataFrame([(f"u{rng.randrange(4)}", rng.choice("ab"), rng.randrange(0, 4000) / 16, 1.0) for _ in range(400)] + [("short", "a", 1.0, 1.0)], "unit string, channel string, time double, value double")
    units = windows.units_of(obs)
    variants = [(24.0, 24.0), (24.0, 5.0), (7.0, 7.0), (500.0, 10.0)]
    want = [(n, s, 5, 2, 401, windows.windows_over(units, n, s).count(), windows.assign_windows(obs, units, n, s).count()) for n, s in variants]
    assert rows(layouts.corpus_variants(obs, units, variants)) == sorted(want)


def test_a_fit_over_corpora_of_other_channels_and_scales(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    side = ["training" if i % 3 else "held_out" for i in range(600)]
    one = spark.createDataFrame([(i, float(a), float(b), float(100 * (a + b)), s) for i, ((a, b, _), s) in enumerate(zip(x[:300], side))], "id int, a double, b double, y double, side string")
    two = spark.createDataFrame([(i, float(a), float(c), float(7 * (a - c)), s) for i, ((a, _, c), s) in enumerate(zip(x[300:], side))], "id int, a double, c double, y double, side string")
    got = learners.cross_corpus_fit({"one": (one, 100.0), "two": (two, 7.0)}, ["id"], {"one": ["a", "b"], "two": ["a", "c"]}, "side", "y", 1000, rounds=60).toPandas()
    assert list(got.columns) == ["corpus", "id", "y", "predicted"] and len(got) == 200
    for _, part in got.groupby("corpus"):
        assert np.corrcoef(part["y"], part["predicted"])[0, 1] > 0.9
        assert 0.6 < part["predicted"].std() / part["y"].std() < 1.2  # the corpus's own scale is back


def test_stays_2019_refuses_labels_that_are_none(spark, tmp_path):
    (tmp_path / "p1.psv").write_text("HR|ICULOS\n1|1\n")
    with pytest.raises(ValueError, match="SepsisLabel"):
        formats.read_stays_2019(spark, str(tmp_path))
    (tmp_path / "p1.psv").write_text("HR|Age|ICULOS|SepsisLabel\n1|60|1|2\n")
    with pytest.raises(Exception, match="label other than 0 and 1"):
        formats.read_stays_2019(spark, str(tmp_path))[0].collect()
