import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from obsengine.streaming import readings as stream

SCHEMA = "unit string, channel string, ts timestamp, value double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng, at = random.Random(0), dt.datetime(2024, 1, 1)
    rows = [(f"u{rng.randrange(3)}", rng.choice("ab"), at + dt.timedelta(minutes=i), float(rng.randrange(100))) for i in range(600)]
    path = str(tmp_path_factory.mktemp("stream"))
    for i in range(0, 600, 200):
        spark.createDataFrame(rows[i : i + 200], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def replay(spark, source, transform, mode):
    out = transform(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    name = f"t{random.getrandbits(40)}"
    out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("transform", [stream.stream_hourly, lambda d: stream.stream_windows(d, "2 hours", "1 hour"), stream.stream_statistics])
def test_stream_equals_batch(spark, source, transform):
    assert rows_of(replay(spark, source, transform, "complete")) == rows_of(transform(spark.read.schema(SCHEMA).parquet(source)))


def test_dedupe_keeps_one_of_an_instant(spark, source):
    twice = lambda d: stream.stream_dedupe(d.unionByName(d))
    got = replay(spark, source, twice, "append")
    assert rows_of(got) == rows_of(spark.read.schema(SCHEMA).parquet(source).distinct())


def test_normalise_against_static_statistics(spark, source):
    stats = spark.createDataFrame([("a", 10.0, 2.0), ("b", 5.0, 0.0)], "channel string, mean double, std double")
    got = replay(spark, source, lambda d: stream.stream_clean_normalise(d, stats), "append")
    want = spark.read.schema(SCHEMA).parquet(source).withColumn("value", F.when(F.col("channel") == "a", (F.col("value") - 10) / 2).otherwise(F.col("value") - 5))
    assert rows_of(got) == rows_of(want)
