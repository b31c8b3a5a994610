"""The folder that a whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this machine
    serves a local master; on a cluster, whose executors wouldn't see it, it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillrun-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df in the shared folder, its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame, per_file: int = 0) -> DataFrame:
    """df in the shared folder as Parquet, its lineage cut: later reads take single columns or files. A file has
    up to ``per_file`` rows, where that is given."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A folder as tasks open it: local paths and what pyarrow's file systems reach (file, s3, gs, hdfs)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
