"""Checkpoints of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process (as in tests) may do without and gets a folder of its own."""
    sc = spark.sparkContext
    set_ = sc.getConf().get("spark.checkpoint.dir")
    if not set_ and (sc.master or "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_ or tempfile.mkdtemp(prefix="tessera-"))
    return set_ or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
