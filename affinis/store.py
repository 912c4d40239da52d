"""The shared folder of a cluster, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="affinis-")
    return _own_dirs[app]


def delete(spark: SparkSession, path: str) -> None:
    """Best effort: a stopped session leaves the folder to the cluster's own cleaning."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused folder in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/affinis-{tag}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
