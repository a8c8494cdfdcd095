"""Session settings that operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: what ``spark.checkpoint.dir`` names.

    Only where the setting is absent and Spark runs on this one machine (tests) a temporary
    folder is used; on a cluster executors could not reach it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if getattr(spark, "_codecorpus_folder", None) is None:
        spark._codecorpus_folder = tempfile.mkdtemp(prefix="codecorpus-")
    return spark._codecorpus_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this application has written to the shared folder; results not yet written are lost."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(settings).delete(place, True)
    return len(paths)


def with_scheme(spark: SparkSession, path: str) -> str:
    """The path on the default file system of the session, if it names none itself."""
    if "://" in path:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if default.startswith("file:") else default.rstrip("/") + path


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from what was written.

    Later steps neither recompute what led to it nor depend on one executor.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)
