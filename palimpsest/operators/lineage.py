"""Cutting lineage with a table written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local session without a setting, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster must name: without it a cluster's session raises, as executors share no folder of one machine.

    Only a session in local mode, as in tests, gets a temporary folder, which is deleted when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        path = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[context.applicationId] = f"file://{path}"
    return _LOCAL[context.applicationId]


#: Folders written since the last ``drop_materialized``.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame as Parquet in the shared folder and reads it back.

    What follows reads it as often as it needs to, and a lost executor costs no recomputation of what came before.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> int:
    """Deletes the folders that ``materialize`` has written; frames that read them can no longer be used. Gives their number."""
    jvm, n = spark._jvm, len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
