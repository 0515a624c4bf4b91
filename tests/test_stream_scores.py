"""Departures and answers of streams against the same work on tables."""

import pytest
from pyspark.sql import functions as F

from obsengine.operators import detect
from obsengine.streaming import scores


def test_stream_departures_equal_the_table(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("u"), (F.col("id") % 2).cast("string")).alias("unit"), F.floor(F.col("id") / 2).alias("position"), F.lit("c").alias("channel"), *[(F.sin(F.col("id") * (i + 1)) * 3).alias(v) for i, v in enumerate(detect.VALUES)]).where("position NOT IN (4, 5, 6, 7)")
    floor = detect.departure_floor(rows)
    want = {(r["unit"], r["position"]): r["departure"] for r in detect.channel_departures(rows, floor).collect()}
    for i, part in enumerate((rows.where("position < 9"), rows.where("position >= 9"), rows.where("position = 3"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        query = scores.stream_departures(stream, floor).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    late = [r for r in got if r["departure"] is None]
    told = {(r["unit"], r["position"]): r["departure"] for r in got if r["departure"] is not None}
    assert told == pytest.approx(want) and {r["position"] for r in late} == {3} and len(late) == 2


def test_stream_score_answers_or_refuses(spark, tmp_path):
    data = [("a", "x", 0.5, 1.0), ("a", "x", 0.7, 3.0), ("b", "y", 0.1, 1.0), ("c", "x", 0.1, float("nan")), ("d", "x", 1.5, 1.0), ("e", None, 0.1, 1.0), ("b", "x", 0.2, 1.0)]
    rows = spark.createDataFrame(data, "request string, channel string, time double, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    scores.stream_score(stream, ["x"], lambda df: df.groupBy("request").agg(F.avg("value").alias("answer")), f"{tmp_path}/to", f"{tmp_path}/cp").awaitTermination()
    assert [(r["request"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/to/answers").collect()] == [("a", 2.0)]
    refused = {r["request"]: r["refused"] for r in spark.read.parquet(f"{tmp_path}/to/refused").collect()}
    assert refused == {"b": "unknown channel", "c": "no number", "d": "outside the window", "e": "unknown channel"}
