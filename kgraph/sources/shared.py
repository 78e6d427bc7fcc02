"""The folder that driver and executors share, and cutting lineage at files in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, one of our own, if all of Spark
    runs on this machine; a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        had = context._jsc.sc().getCheckpointDir()
        if had.isDefined():
            folder = had.get()
        elif context.master.split("[")[0] == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='kgraph-shared-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage at files in the shared folder; the files go when the data is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
