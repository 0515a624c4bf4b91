"""Files of public corpora as readings: every reader scans with a given schema and gives `(unit, channel, time, value)`.

Readers of many small files take the unit from the file's name. A value that isn't recorded is an absent row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.repair import keep_preferred, most_frequent, one_row_per_instant, scale_within_unit, units_with_least, widest_channels
from ..operators.sides import thin_to_cap
from .tables import describe, finite, hours_since, to_long

# Ward codes, and the descriptors that stand at 00:00 of a stay.
WARDS = {1: "coronary care", 2: "cardiac surgery recovery", 3: "medical", 4: "surgical"}
STAY_DESCRIPTORS = ("Age", "Gender", "Height", "ICUType", "RecordID")
# Static columns of an hourly stay.
HOURLY_DESCRIPTORS = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime")


def file_stem() -> Column:
    """The name of the file that a row comes from, without folder and extension."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def clock_hours(c: Column | str) -> Column:
    """`HH:MM` in hours; anything else is null."""
    return F.try_to_number(F.regexp_extract(c, r"^(\d+):(\d+)$", 1), F.lit("99999")).cast("double") + F.try_to_number(F.regexp_extract(c, r"^(\d+):(\d+)$", 2), F.lit("99")).cast("double") / 60


def read_long_csv(spark: SparkSession, path: str, columns: Mapping[str, str], clock: bool = False, missing: float | None = None, skip: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """A long table. `columns` names the file's `channel`, `time` and `value`, and `unit` unless the file's name is it."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    unit = F.col(columns["unit"]) if "unit" in columns else file_stem()
    time = clock_hours(F.col(columns["time"])) if clock else F.col(columns["time"]).try_cast("double")
    rows = raw.select(unit.alias("unit"), F.col(columns["channel"]).alias("channel"), time.alias("time"), F.col(columns["value"]).try_cast("double").alias("value"))
    rows = finite(rows.where(F.col("channel").isNotNull() & F.col("time").isNotNull() & ~F.col("channel").isin(*skip)))
    return rows if missing is None else rows.where(F.col("value") != missing)


def read_stays_2012(spark: SparkSession, path: str, hours: float = 48.0) -> tuple[DataFrame, DataFrame]:
    """Stays of one file each: readings within `hours`, and statics `(unit, channel, value)`.

    Descriptors stand at 00:00 and -1 is not recorded; the ward is a presence of value 1. The weight at admission is
    the first reading of its own series, so it stays a reading. A stay of descriptors only has statics alone.
    """
    rows = read_long_csv(spark, path, {"channel": "Parameter", "time": "Time", "value": "Value"}, clock=True, missing=-1.0)
    held = F.col("channel").isin(*STAY_DESCRIPTORS) & (F.col("time") == 0)
    ward = F.create_map(*[F.lit(x) for k, v in WARDS.items() for x in (float(k), v)])
    is_ward = F.col("channel") == "ICUType"
    statics = rows.where(held & (F.col("channel") != "RecordID")).select("unit", F.when(is_ward, F.concat(F.lit("ICUType/"), F.try_element_at(ward, F.col("value")))).otherwise(F.col("channel")).alias("channel"), F.when(is_ward, 1.0).otherwise(F.col("value")).alias("value"))
    return rows.where(~F.col("channel").isin(*STAY_DESCRIPTORS) & F.col("time").between(0, hours)), statics.where("channel IS NOT NULL").distinct()


def read_stays_2019(spark: SparkSession, path: str, excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: hourly wide rows between bars: readings, statics and units `(unit, extent_start, extent_end)`.

    The hour is `ICULOS`, the label column is never a channel, and an extent goes from the first hour to one past the last.
    A file without the label column is refused, and so is, when its row is read, a label other than 0 and 1.
    """
    raw = spark.read.option("header", True).option("sep", "|").csv(path).withColumn("unit", file_stem())
    if "SepsisLabel" not in raw.columns:
        raise ValueError(f"{path}: no column SepsisLabel")
    label = F.col("SepsisLabel").try_cast("double")
    bad = F.raise_error(F.concat(F.lit("label other than 0 and 1: "), F.coalesce("SepsisLabel", F.lit("none")), F.lit(" in "), F.col("unit")))
    raw = raw.where(F.when(label.isin(0.0, 1.0), F.lit(True)).otherwise(bad.cast("boolean")))
    raw = raw.where(~F.col("unit").isin(*excluded)).withColumn("time", F.col("ICULOS").try_cast("double"))
    names = [c for c in raw.columns if c not in ("unit", "time", "ICULOS", "SepsisLabel")]
    numbers = raw.select("unit", "time", *[F.col(c).try_cast("double").alias(c) for c in names])
    own = [c for c in names if c in HOURLY_DESCRIPTORS]
    readings = to_long(numbers, ["unit", "time"], [c for c in names if c not in own]).select("unit", "channel", "time", "value")
    statics = to_long(numbers.groupBy("unit").agg(*[F.min(F.when(~F.isnan(c), F.col(c))).alias(c) for c in own]), ["unit"], own)
    return readings, statics, numbers.groupBy("unit").agg(F.min("time").alias("extent_start"), (F.max("time") + 1).alias("extent_end"))


def read_turbofan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows between white space of unit, cycle, 3 settings and 21 sensors: readings and units with extent `[1, L + 1)`.

    A unit is `<subset>/<engine>`, the subset the last part of the file's name. Rows of another width are refused.
    """
    names = [f"setting{i}" for i in range(1, 4)] + [f"sensor{i}" for i in range(1, 22)]
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_extract(file_stem(), r"([^_]+)$", 1).alias("subset"), F.split(F.trim("value"), r"\s+").alias("p"))
    width = F.when(F.size("p") == 26, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("a row of other than 26 fields: "), F.size("p").cast("string"))).cast("array<string>"))
    wide = parts.withColumn("p", width).select(F.concat_ws("/", "subset", F.col("p")[0]).alias("unit"), F.col("p")[1].cast("double").alias("time"), *[F.col("p")[i + 2].cast("double").alias(c) for i, c in enumerate(names)])
    return to_long(wide, ["unit", "time"], names).select("unit", "channel", "time", "value"), wide.groupBy("unit").agg(F.lit(1.0).alias("extent_start"), (F.max("time") + 1).alias("extent_end"))


def read_row_indexed(spark: SparkSession, path: str, prefix: str = "metric") -> DataFrame:
    """Comma rows without header or clock: the row's index is its time.

    Rows of a file are only ordered inside it, so a file (some ten MB here) is read whole by one task.
    """
    text = spark.read.text(path, wholetext=True).select(file_stem().alias("unit"), F.posexplode(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), r"\r?\n")).alias("time", "line"))
    cells = text.where("line <> ''").select("unit", F.col("time").cast("double").alias("time"), F.posexplode(F.split("line", ",")).alias("i", "v"))
    return finite(cells.select("unit", F.format_string(f"{prefix}%02d", F.col("i") + 1).alias("channel"), "time", F.col("v").try_cast("double").alias("value")))


def read_testbed(spark: SparkSession, path: str, labels: Sequence[str] = ("anomaly", "changepoint")) -> tuple[DataFrame, DataFrame]:
    """Semicolon tables, one per experiment: seconds since its first row; the extent ends a second past the last."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path).withColumn("unit", file_stem()).withColumn("at", F.unix_micros(F.col("datetime").cast("timestamp")) / 1e6)
    raw = raw.where("at IS NOT NULL").withColumn("time", F.col("at") - F.min("at").over(Window.partitionBy("unit")))
    names = [c for c in raw.columns if c not in ("datetime", "unit", "at", "time", *labels)]
    readings = to_long(raw.select("unit", "time", *[F.col(c).try_cast("double").alias(c) for c in names]), ["unit", "time"], names)
    return readings.select("unit", "channel", "time", "value"), raw.groupBy("unit").agg(F.lit(0.0).alias("extent_start"), (F.max("time") + 1).alias("extent_end"))


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fragments of one channel each in one table: readings, and units with part, extent and anomaly.

    Time counts seconds from the fragment's first row; a row occupies its sampling period, so the extent is one longer.
    """
    schema = "channel string, timestamp timestamp, value double, label string, sampling double, anomaly int, segment string, train int"
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    rows = raw.withColumn("at", F.unix_micros("timestamp") / 1e6).withColumn("time", F.col("at") - F.min("at").over(Window.partitionBy("segment")))
    part = F.when(F.max("train") == 1, "training").otherwise("test").alias("part")
    units = rows.groupBy(F.col("segment").alias("unit")).agg(part, F.lit(0.0).alias("extent_start"), (F.max("time") + F.max("sampling")).alias("extent_end"), F.max("anomaly").alias("anomaly"))
    return finite(rows.select(F.col("segment").alias("unit"), "channel", "time", "value")), units


def read_process_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs of a process in Parquet, a row per sample: readings and units `fault<nn>-run<nnn>` with extent `[1, L + 1)`."""
    raw = spark.read.parquet(path)
    names = [c for c in raw.columns if c.startswith(("xmeas_", "xmv_"))]
    wide = raw.withColumn("unit", F.format_string("fault%02d-run%03d", F.col("faultNumber").cast("int"), F.col("simulationRun").cast("int"))).withColumn("time", F.col("sample").cast("double"))
    return to_long(wide, ["unit", "time"], names).select("unit", "channel", "time", "value"), wide.groupBy("unit").agg(F.lit(1.0).alias("extent_start"), (F.max("time") + 1).alias("extent_end"))


def telemetry_half(rows: DataFrame, group: str = "mission", width: float = 30.0, ts: str = "ts") -> DataFrame:
    """The first half of each mission by time, thinned to the earliest reading per bin, by calendar month.

    Half is the floor of the span's middle in seconds, cut back to a bin. Time is hours since the mission's first reading.
    """
    at = rows.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    span = at.groupBy(group).agg(F.min("at").alias("start"), F.max("at").alias("stop"))
    span = span.withColumn("cutoff", F.col("start") + F.floor(F.floor((F.col("stop") - F.col("start")) / 2) / width) * width)
    kept = at.join(span, group).where("at < cutoff").withColumn("bin", F.floor((F.col("at") - F.col("start")) / width))
    first = kept.groupBy(group, "channel", "bin").agg(F.min(F.struct("at", "value")).alias("r"), F.min("start").alias("start"))
    month = F.date_format(F.timestamp_micros((F.col("r.at") * 1e6).cast("long")), "yyyy-MM")
    return first.select(F.concat_ws("/", group, month).alias("unit"), "channel", ((F.col("r.at") - F.col("start")) / 3600).alias("time"), F.col("r.value").alias("value"))


def telemetry_raw(rows: DataFrame, channels: Sequence[str], origin: str, excluded: Sequence[str] = (), ts: str = "ts", cap: int | None = None) -> DataFrame:
    """Chosen channels over the whole span by calendar month, some months left out, hours from a fixed origin.

    With `cap` a channel of more readings over its whole span is thinned to bins of whole seconds (D9), before months.
    """
    own = rows.where(F.col("channel").isin(*channels))
    if cap is not None:
        seconds = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', {ts})") / F.lit(1e6)
        own = thin_to_cap(own.select(F.lit("all").alias("unit"), "channel", seconds.alias("time"), "value"), cap, 1.0)
        own = own.withColumn(ts, F.timestamp_add("MICROSECOND", F.round(F.col("time") * 1e6).cast("long"), F.lit(origin).cast("timestamp_ntz")))
    month = F.date_format(ts, "yyyy-MM")
    return finite(own.where(~month.isin(*excluded)).select(month.alias("unit"), "channel", hours_since(ts, origin).alias("time"), "value"))


def icu_readings(patients: DataFrame, charted: Mapping[str, DataFrame], codes: DataFrame, least_hours: float = 48.0) -> DataFrame:
    """Charting, lab and output tables of a hospital as one table of readings of stays of `least_hours` or more.

    `charted`: by table name `(stay, minute, code, value, revised)`; `codes`: `(table, code, channel)`, few rows. Of
    readings at one instant the last revised counts, then the smallest value. Admission weight is a reading at minute 0.
    """
    stays = patients.where(F.col("discharge_minute") >= least_hours * 60).select("stay", "weight")
    rows = None
    for name in sorted(charted):
        one = charted[name].select("stay", "minute", F.lit(name).alias("table"), "code", F.col("value").try_cast("double").alias("value"), "revised")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(F.broadcast(codes), ["table", "code"]).join(stays.select("stay"), "stay").select("stay", "minute", "channel", "value", "revised")
    weight = stays.where("weight > 0").select("stay", F.lit(0).alias("minute"), F.lit("weight").alias("channel"), F.col("weight").cast("double").alias("value"), F.lit(None).cast("long").alias("revised"))
    one = keep_preferred(finite(rows.unionByName(weight)), ["stay", "channel", "minute"], [F.desc_nulls_last("revised"), F.asc("value")])
    return one.select(F.col("stay").cast("string").alias("unit"), "channel", (F.col("minute") / 60.0).alias("time"), "value")


def signal_columns(header: Sequence[str], signals: Mapping[str, str]) -> list[str]:
    """The columns `Title (unit)` of the named signals; statistics are ignored, a title over another unit is refused."""
    found = []
    for title, unit in signals.items():
        over = [h for h in header if h.startswith(f"{title} (")]
        if f"{title} ({unit})" not in over:
            raise ValueError(f"{title}: in {over or 'no column'}, not in {unit}")
        found.append(f"{title} ({unit})")
    return found


def read_turbine_tables(spark: SparkSession, path: str, signals: Mapping[str, str], instant: str, origin: str) -> DataFrame:
    """Wide ten-minute tables, a file per turbine: the named signals by turbine month, the least of repeated instants."""
    raw = spark.read.option("header", True).csv(path)
    names = signal_columns(raw.columns, signals)
    at = F.col(instant).cast("timestamp_ntz")
    wide = raw.withColumn("unit", F.concat_ws("/", file_stem(), F.date_format(at, "yyyy-MM"))).withColumn("ts", at)
    wide = wide.select("unit", hours_since("ts", origin).alias("time"), *[F.col(f"`{c}`").try_cast("double").alias(c.rsplit(" (", 1)[0]) for c in names])
    return one_row_per_instant(to_long(wide.where("time IS NOT NULL"), ["unit", "time"], list(signals))).select("unit", "channel", "time", "value")


def water_quality(results: DataFrame, organisation: Column, channels: int = 64, least: int = 50) -> DataFrame:
    """Result rows `(location, channel, ts_hours, value, unit_code)` of the main organisation as readings.

    Exact repeats go; of each channel its most frequent unit code counts; of values at one instant the least; then the
    channels that most locations read and the locations with enough readings.
    """
    rows = finite(results.where(organisation).select("location", "channel", "ts_hours", "value", "unit_code")).distinct()
    codes = most_frequent(rows, ["channel"], "unit_code").select("channel", "unit_code")
    own = one_row_per_instant(rows.join(F.broadcast(codes), ["channel", "unit_code"]).select(F.col("location").alias("unit"), "channel", F.col("ts_hours").alias("time"), "value"))
    own = own.join(F.broadcast(widest_channels(own, channels).select("channel")), "channel").select("unit", "channel", "time", "value")
    return units_with_least(own, least)


def read_series_arrays(rows: DataFrame, pattern: str = r"^(.*?)(?:_(\d+))?$", item: str = "item_id", target: str = "target") -> DataFrame:
    """Arrays of values as readings at their index; `pattern` splits an id into series and variate (none: variate 0).

    Values are scaled within a unit and channel; a value that isn't finite keeps its place free.
    """
    own = rows.select(F.regexp_extract(item, pattern, 1).alias("unit"), F.concat(F.lit("variate"), F.coalesce(F.nullif(F.regexp_extract(item, pattern, 2), F.lit("")), F.lit("0"))).alias("channel"), F.posexplode(target).alias("time", "value"))
    return scale_within_unit(finite(own.select("unit", "channel", F.col("time").cast("double").alias("time"), F.col("value").cast("double").alias("value"))))


def choose_parts(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The rows of some parts, units keyed `<part>/<unit>`; a part that holds nothing is refused."""
    held = {r[0] for r in df.where(F.col("part").isin(*parts)).select("part").distinct().collect()}
    if set(parts) - held:
        raise ValueError(f"no such part: {sorted(set(parts) - held)}")
    return df.where(F.col("part").isin(*parts)).withColumn("unit", F.concat_ws("/", "part", "unit"))


def publish(tokens: DataFrame, folder: str, manifest: Mapping[str, object], part: str = "part", source: DataFrame | None = None, fingerprint: int | None = None) -> str:
    """Tokens by part, a unit's rows in one file of its part, and the manifest; the path under `folder`, all or nothing.

    The path's name follows from the tokens' digest, their columns and the manifest, so the same data and spec give the
    same path, and what is there is not written again. Tokens go to a folder of the attempt; the commit, written last,
    names it. A job that dies before leaves an attempt that nobody reads; of attempts that end at once the first by
    name counts, and both hold the same. With `source`, the readings that the tokens were made of, their description
    joins the manifest, and readings whose `fingerprint` isn't the one given are refused: they have moved since.
    """
    spark = tokens.sparkSession
    if source is not None:
        found = describe(source).first().asDict()
        if fingerprint is not None and found["fingerprint"] != fingerprint:
            raise ValueError(f"the source's fingerprint is {found['fingerprint']}, not {fingerprint}")
        manifest = {**manifest, **found}
    key = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(tokens.columns))), 256), 1, 15), 16, 10).cast("decimal(19,0)")
    total, n = tokens.agg(F.sum(key), F.count(F.lit(1))).first()
    spec = json.dumps([[k, str(v)] for k, v in sorted(manifest.items())] + sorted(tokens.dtypes) + [part, str(total), n])
    path = f"{folder}/{hashlib.sha256(spec.encode()).hexdigest()[:32]}"
    if committed(spark, path) is None:
        attempt = uuid.uuid4().hex
        tokens.repartition(part, "unit").sortWithinPartitions(part, "unit", "position").write.partitionBy(part).parquet(f"{path}/{attempt}/tokens")
        spark.createDataFrame([(k, str(v)) for k, v in sorted(manifest.items())], "key string, value string").coalesce(1).write.json(f"{path}/{attempt}/manifest")
        spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("append").json(f"{path}/commit")
    return path


def committed(spark: SparkSession, path: str) -> str | None:
    """The folder of a published path's attempt that counts; none if no attempt has come to its end."""
    try:
        first = spark.read.schema("attempt string").json(f"{path}/commit").agg(F.min("attempt")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if first is None else f"{path}/{first}"


def read_published(spark: SparkSession, path: str, parts: Sequence[str] | None = None, units: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Published tokens, of some parts (whose folders alone are listed), units, or `(unit, position)` only."""
    at = committed(spark, path)
    if at is None:
        raise ValueError(f"nothing is published in {path}")
    df = spark.read.parquet(f"{at}/tokens")
    df = df if parts is None else df.where(F.col("part").isin(*parts))
    df = df if units is None else df.join(units.select("unit").distinct(), "unit", "left_semi")
    return df if positions is None else df.join(positions.select("unit", "position").distinct(), ["unit", "position"], "left_semi")


def read_outcomes(spark: SparkSession, path: str, key: str = "RecordID") -> DataFrame:
    """Outcomes of records in long form `(unit, outcome, value)`."""
    raw = spark.read.option("header", True).csv(path)
    names = [c for c in raw.columns if c != key]
    return to_long(raw.select(F.col(key).alias("unit"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names]), ["unit"], names).withColumnRenamed("channel", "outcome")


def read_events(spark: SparkSession, labels: str, types: str) -> DataFrame:
    """Event rows per channel with their category: `(event, channel, start, end, category, row)`; row is the file's order."""
    raw = spark.read.schema("ID string, Channel string, StartTime timestamp, EndTime timestamp").option("header", True).csv(labels)
    kinds = spark.read.option("header", True).csv(types).select(F.col("ID").alias("event"), F.col("Category").alias("category"))
    rows = raw.select(F.col("ID").alias("event"), F.col("Channel").alias("channel"), F.col("StartTime").alias("start"), F.col("EndTime").alias("end"), F.monotonically_increasing_id().alias("row"))
    return rows.join(F.broadcast(kinds), "event", "left")


def export_predictions(predictions: DataFrame, path: str) -> None:
    """Every answer of every run as flat rows, a folder for each run; a run's units are spread over tasks."""
    predictions.repartition("run", "unit").sortWithinPartitions("run", "unit", "position").write.partitionBy("run").parquet(path)


def read_pairs(spark: SparkSession, path: str, control: str, candidate: str) -> DataFrame:
    """Two runs' answers side by side by unit and position; the scan opens their folders only."""
    runs = spark.read.schema("unit string, position long, target double, predicted double, run string").parquet(path)
    a, b = (runs.where(F.col("run") == x).select("unit", "position", "target", F.col("predicted").alias(n)) for x, n in ((control, "control"), (candidate, "candidate")))
    return a.join(b.drop("target"), ["unit", "position"])
