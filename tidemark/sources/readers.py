"""Readers: overlapping exports, scaled sheets, weather archives, directories; all become long tables with NULL for missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import known
from tidemark.operators.shape import keep_first, mask_outside

#: Canonical channels and the header each has in an export file (fixed values of the file format).
CHANNELS = {
    "energy": "Energy (kWh)", "flow": "Volume flow (l/h)", "power": "Power (kW)", "dt": "Temperature difference (°C)",
    "vl": "Flow temperature (°C)", "rt": "Return temperature (°C)", "volume": "Volume (m³)",
}
#: Plausible ranges; a value outside is missing.
LIMITS = {"flow": (0.0, 50_000.0), "power": (-50.0, 5_000.0), "vl": (-5.0, 160.0), "rt": (-5.0, 160.0), "dt": (-50.0, 150.0)}


def exports(spark: SparkSession, folder: str, stamp: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """meter, file, ts and the channels of all `<meter>_*.csv` in a folder. Files are found by the reader's glob and the meter is taken from
    the name; a file without a Timestamp column is an error when it is read."""
    schema = ", ".join(f"`{h}` double" for h in CHANNELS.values())
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(f"Timestamp string, {schema}").option("pathGlobFilter", "*_*.csv").csv(folder)
    name = F.col("_metadata.file_name")
    meter = F.regexp_extract(name, r"^(\d+)_.*\.csv$", 1)
    out = raw.select(meter.alias("meter"), name.alias("file"), F.to_timestamp_ntz("Timestamp", F.lit(stamp)).alias("ts"), *[known(F.col(f"`{h}`")).alias(c) for c, h in CHANNELS.items()])
    return out.where("meter <> ''").withColumn("meter", F.col("meter").cast("bigint"))


def ingest(raw: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row per meter and hour: rows without any channel go, values are masked, the file that has energy and reaches furthest wins, minutes are
    floored to the hour, a missing spread is derived."""
    channels = [c for c in CHANNELS if c in raw.columns]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in channels])
    clean = mask_outside(raw.where(some), limits or LIMITS)
    rank = clean.groupBy("meter", "file").agg(F.max(F.col("energy").isNotNull().cast("int")).alias("_e"), F.max("ts").alias("_t"))
    d = clean.join(rank, ["meter", "file"]).withColumn("_raw", F.col("ts")).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    d = keep_first(d, ["meter", "ts"], F.desc("_e"), F.desc("_t"), F.desc("_raw"), F.desc("file"))
    return d.withColumn("dt", F.coalesce("dt", F.col("vl") - F.col("rt"))).drop("_e", "_t", "_raw", "file")


def weather(spark: SparkSession, path: str) -> DataFrame:
    """ts (UTC) and t_out of semicolon-separated hourly station files; -999 and below is missing."""
    raw = spark.read.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    t = F.col("TT_TU").cast("double")
    d = raw.select(F.to_timestamp_ntz("MESS_DATUM", F.lit("yyyyMMddHH")).alias("ts"), F.when(t > -999, t).alias("t_out"), F.monotonically_increasing_id().alias("_i"))
    return keep_first(d.where("ts is not null"), ["ts"], F.desc("_i")).drop("_i")


def local_time(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """UTC times as local wall-clock times; of the two equal hours in autumn the first stays."""
    d = df.withColumn("_u", F.col(ts)).withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts)))
    return keep_first(d, [ts], F.col("_u")).drop("_u")


def scaled_sheet(spark: SparkSession, path: str, factor: float) -> DataFrame:
    """An integer sheet saved as CSV, rescaled; counters are missing."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return raw.select(*[(F.col(c) / factor).alias(c) if c != "ts" else F.col(c).cast("timestamp_ntz").alias("ts") for c in raw.columns])


def stale(raw: DataFrame, prepared: DataFrame) -> DataFrame:
    """meter, raw_end, prepared_end of meters whose raw rows go on after the prepared ones, or that were never prepared."""
    a = raw.groupBy("meter").agg(F.max("ts").alias("raw_end"))
    b = prepared.groupBy("meter").agg(F.max("ts").alias("prepared_end"))
    return a.join(b, "meter", "left").where("prepared_end is null or raw_end > prepared_end")


def latest_address(directory: DataFrame, key: str = "meter", address: str = "address", year: str = "year") -> DataFrame:
    return directory.groupBy(key).agg(F.max_by(address, F.struct(year, address)).alias(address))


def swaps(directory: DataFrame, place: str = "key", meter: str = "meter", year: str = "year") -> DataFrame:
    """place, n_meters, kind: 'swap' if meters follow each other, 'parallel' if a year has several."""
    per = directory.groupBy(place, year).agg(F.countDistinct(meter).alias("_n"))
    n = directory.groupBy(place).agg(F.countDistinct(meter).alias("n_meters"))
    return n.join(per.groupBy(place).agg(F.max("_n").alias("_m")), place).where("n_meters > 1").select(place, "n_meters", F.when(F.col("_m") > 1, "parallel").otherwise("swap").alias("kind"))
