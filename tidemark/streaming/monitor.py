"""The monitoring chain on streams: daily aggregates under a watermark and CUSUM accounts in keyed state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and outputs in the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def day_aggregate(stream: DataFrame, key: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """key, day, n, sum_v: tumbling days under a watermark; rows later than `late` behind the newest are dropped."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = s.groupBy(F.col(key).alias("entity"), F.window("_ts", "1 day").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_v"))
    return g.select("entity", F.to_date("_w.start").alias("day"), "n", "sum_v")


def cusum_state(stream: DataFrame, key: str, k: float = 0.5, h: float = 5.0, cap: float = 10.0) -> DataFrame:
    """entity, day, direction, start of alarms as they come: a stream of (key, day, z) with both accounts as keyed state. Rows of a batch are taken
    in order of days; days at or before the last one seen are late and left out."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()
    state_schema = "up double, down double, arm_up boolean, arm_down boolean, from_up date, from_down date, last date"

    def step(name, frames, state):
        up, down, arm_up, arm_down, from_up, from_down, last = state.get if state.exists else (0.0, 0.0, True, True, None, None, None)
        out = []
        rows = pd.concat(list(frames)).dropna(subset=["z"]).sort_values("day")
        for r in rows.itertuples(index=False):
            if last is not None and r.day <= last:
                continue
            last = r.day
            from_up, from_down = (r.day if up == 0 else from_up), (r.day if down == 0 else from_down)
            up, down = min(max(0.0, up + r.z - k), cap), min(max(0.0, down - r.z - k), cap)
            for side, account, armed, start in ((1, up, arm_up, from_up), (-1, down, arm_down, from_down)):
                if armed and account > h:
                    out.append((name[0], r.day, side, start))
            arm_up, arm_down = up == 0 or (arm_up and not up > h), down == 0 or (arm_down and not down > h)
        state.update((up, down, arm_up, arm_down, from_up, from_down, last))
        yield pd.DataFrame(out, columns=["entity", "day", "direction", "start"])

    return stream.groupBy(key).applyInPandasWithState(step, f"entity {kind}, day date, direction int, start date", state_schema, "append", GroupStateTimeout.NoTimeout)


def finish(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is available now and read what it wrote."""
    out = folder(spark, "stream-out")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start()
    else:  # the last complete result replaces those before
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", folder(spark, "stream-state")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_day_aggregate(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    src = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    return finish(spark, day_aggregate(src, "user_id", "ts", "value"), "complete")


def run_cusum(spark: SparkSession, z: DataFrame) -> DataFrame:
    at = folder(spark, "stream-in")
    z.write.parquet(at)
    return finish(spark, cusum_state(spark.readStream.schema(z.schema).parquet(at), "entity"))
