"""Intermediate tables in the folder that driver and executors share.

Writing a table cuts the lineage: a lost executor costs the tasks that read the
table again, not the stages that made it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder of our own only where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "vcspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vcspark/{name}-{uuid.uuid4().hex}"


def save_shared(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, by the session's codec unless one is given, and read it back."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def drop_shared(*tables: DataFrame) -> None:
    """Delete saved tables that no plan still to run reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(conf).delete(path, True)
