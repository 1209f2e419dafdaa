"""Streams: event intake, sightings with a gap, profile rebuild per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators import taste
from cellarium.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as they arrive in a folder or under a pattern, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what has arrived into the shared folder and read the result; update mode keeps every update."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/run={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("run")


def allowed_events(stream: DataFrame, names: list[str]) -> DataFrame:
    """Events with an allowed name, stamped on arrival."""
    return stream.where(F.col("event_type").isin(names)).withColumn("received_at", F.current_timestamp())


def once_per_id(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows of a stream without those sent again within ``late``; older ids are forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def count_sightings(events: pd.DataFrame, last: pd.Timestamp | None, n: int, gap: pd.Timedelta) -> tuple[pd.Timestamp | None, int]:
    """Last sighting and number of sightings after these events; one within the gap extends the last."""
    for ts in events["ts"].sort_values():
        if last is None or ts - last > gap:
            n += 1
        last = ts if last is None else max(last, ts)
    return last, n


def sightings(stream: DataFrame, gap_seconds: int = 15) -> DataFrame:
    """``user_id, sightings`` so far, updated per micro-batch; state is one time and one count per user."""
    gap = pd.Timedelta(seconds=gap_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        stamp = None if last is None else pd.Timestamp(last, unit="us")
        # Times only, eight bytes each, so that they can be put in order.
        times = pd.concat([b["ts"] for b in batches])
        stamp, n = count_sightings(times.to_frame("ts"), stamp, n, gap)
        state.update((stamp.value // 1000, n))
        yield pd.DataFrame({"user_id": [key[0]], "sightings": [n]})

    keyed = stream.where("event_type = 'view'").select("user_id", "ts").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, sightings long", "last long, n long", "update", "NoTimeout")


def rebuild_touched(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Signals of the users a batch touches, folded from the whole log."""
    return taste.signals(log.join(batch.select("user_id").distinct(), "user_id", "left_semi"))
