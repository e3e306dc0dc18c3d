"""Revision logs as streams: newly appended records are folded into current state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of an append-only folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def live_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Running number of records and last revision of each key."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.max("revision").alias("revision"))


def apply_batches(log: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hands every micro-batch to ``apply``, which must be safe to repeat for a batch number."""
    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()
