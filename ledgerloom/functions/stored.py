"""Cutting lineage: stages that several later ones read are written to the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from ledgerloom.functions.errors import LedgerError


def stored(df: DataFrame) -> DataFrame:
    """df, checkpointed in the cluster's shared folder. Where none is named a session on one machine (tests) gets a temporary
    one; on a cluster that would not be shared, so it is refused."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise LedgerError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()
