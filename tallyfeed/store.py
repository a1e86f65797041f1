"""Intermediates as Parquet in the folder that all executors share.

``materialize`` writes a DataFrame once and reads it back, so that later stages
read files instead of a lineage that a lost executor would force to be
recomputed. The folder is the one of ``spark.checkpoint.dir``; files stay until
the cluster's own retention removes them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyfeed-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_path(path: str):
    """(pyarrow file system, path in it) of a Hadoop-style path or URI, for tasks that read or write files themselves."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
