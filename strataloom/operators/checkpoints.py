"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of this machine is taken only on a local master, as in tests; a cluster has to name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; checkpoints need a folder that the cluster shares")
        sc.setCheckpointDir(named or f"/tmp/strataloom-checkpoints-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder. Spark deletes its files with the DataFrame if spark.cleaner.referenceTracking.cleanCheckpoints is set, which a long session should do."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
