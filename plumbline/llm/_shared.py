"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``.

    Where that is unset, the session's own checkpoint folder serves. Where there is
    none either, a temporary one does on a local master; on a cluster executors would
    write where others cannot read, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``root``, read back: lost executors cost no earlier work."""
    path = f"{root}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that is read no more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
