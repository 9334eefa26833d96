"""Tables in the folder that all executors share, to end a lineage durably."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, if one machine runs all tasks, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="geoskein-geo-")
    return _OWN[app]


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df, written and to be read again. free: what the writing has shuffled leaves the executors' disks with its end, not
    when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        if free:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(_CLEANUP)
        elif free:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
