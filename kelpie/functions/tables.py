"""Tables written in the folder that all machines share, to cut plans where they would grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the checkpoint folder and read again.

    The planner then knows their size, and nothing before them is planned or run again.  A folder of its own is made
    only where ``spark.checkpoint.dir`` names none and driver and executors are one process.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kelpie-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/kelpie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
