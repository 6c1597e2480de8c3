"""Session settings shared by the benchmark and the tests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names. A session on one machine without it gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        _OWN_DIR[app] = found.rstrip("/")
    return _OWN_DIR[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends here, and losing an executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A local session with AQE on, UTC, and a shuffle width that fits the cores."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("glyphlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
