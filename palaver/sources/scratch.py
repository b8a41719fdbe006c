"""Folders for tables that are written once and read again by other machines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: what follows doesn't compute them again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one that the cluster names, or else under the warehouse; a temporary one only where Spark is local.

    What a session has written is deleted when it ends.
    """
    base = spark.conf.get("spark.palaver.scratch", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            alone = spark.sparkContext.master.split("[")[0] == "local"
            base = "file://" + tempfile.mkdtemp(prefix="palaver-") if alone else spark.conf.get("spark.sql.warehouse.dir")
            if not alone and base.startswith(("file:", "/")):
                raise ValueError("scratch tables need a folder that all machines share: set spark.checkpoint.dir")
        base = f"{base}/palaver-{uuid.uuid4().hex}"
        spark.conf.set("spark.palaver.scratch", base)
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{base}/{uuid.uuid4().hex}"
