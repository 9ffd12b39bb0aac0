"""Work that goes on where it stopped: anti-joins for batches, file streams for new snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def done_before(spark: SparkSession, path: str, key: str, value: str) -> DataFrame | None:
    """Keys of an earlier output that have a value; rows whose value is null count as not done. None without an output."""
    try:
        earlier = spark.read.parquet(path)
    except AnalysisException:
        return None
    return earlier.filter(F.col(value).isNotNull()).select(key).distinct() if {key, value} <= set(earlier.columns) else None


def remaining(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """What is not done yet."""
    return todo if done is None else todo.join(done, key, "left_anti")


def resume(todo: DataFrame, path: str, key: str, value: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``work`` to what an output at ``path`` lacks, and appends the result."""
    work(remaining(todo, done_before(todo.sparkSession, path, key, value), key)).write.mode("append").parquet(path)


def snapshot_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over folders ``sub_collection=...`` of Parquet files: each new file is read once."""
    return spark.readStream.schema(schema).parquet(path)


def append_snapshots(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies ``work`` to each batch of new files and appends the result; ends when all files that are there are done."""

    def batch(df: DataFrame, _: int) -> None:
        work(df).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
