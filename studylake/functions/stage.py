"""Intermediate tables in shared storage.

An ordered step reads its input twice (once for block summaries, once for rows), so a chain of
steps would recompute its source many times over. ``stage`` writes such an intermediate result
once, as columnar files that survive the loss of executors, and reads it back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, under this application's id.

    Where none is set, a temporary folder serves a session whose tasks all run in this process
    (``local[n]``, as in tests); with executors of their own, that is an error.
    """
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
        folder = _LOCAL[app]
    return f"{folder.rstrip('/')}/studylake/{app}"


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df``, computed and stored once."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, path: str) -> None:
    """Deletes a stored intermediate whose readers have finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
