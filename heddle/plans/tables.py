"""Cutting lineage: a reliable checkpoint in the folder that the cluster names, one of our own only where none is set."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the folder that spark.checkpoint.dir names; one of our own only where all run here."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="heddle-")
        sc.setCheckpointDir(where)
    return df.checkpoint()
