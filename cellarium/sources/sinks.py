"""Sinks: upserts by rewriting, deletes, append-only logs, versioned indexes, pre-images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.medallion import latest_rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Old and new rows, the greatest ``seq`` of each key winning. A second run changes nothing."""
    return latest_rows(old.unionByName(new, allowMissingColumns=True), keys, [seq])


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; null keys stay."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def append_events(events: DataFrame, allowed: DataFrame, path: str) -> None:
    """Append events with an allowed name, stamped with their arrival."""
    kept = events.join(F.broadcast(allowed.select("name").distinct()), "name", "left_semi")
    kept.withColumn("_received_at", F.current_timestamp()).write.mode("append").json(path)


def write_index(postings: DataFrame, path: str, stamp: str) -> None:
    """Postings under the stamp of their content, clustered by token."""
    postings.repartition("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/stamp={stamp}")


def pre_image(rows: DataFrame, touched: DataFrame, saved: DataFrame | None, key: str) -> DataFrame:
    """Rows as they were before their first destructive change; what was saved earlier wins."""
    now = rows.join(touched.select(key).distinct(), key, "left_semi")
    return now if saved is None else saved.unionByName(now.join(saved.select(key), key, "left_anti"))


def content_stamp(rows: DataFrame, changed: str) -> str:
    """A stamp that changes with the content: how many rows there are and when the last one changed."""
    r = rows.agg(F.count("*").alias("n"), F.max(changed).alias("at")).first()
    return f"{r['n']}-{r['at'].isoformat() if r['at'] else 'never'}".replace(":", ".")


def load_index(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """The postings of this stamp; an error if there are none, so that a stale index is never read."""
    return spark.read.parquet(f"{path}/stamp={stamp}")


def append_evidence(rows: DataFrame, path: str) -> None:
    """Append what was fetched, when, and what came of it; nothing is ever rewritten."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)
