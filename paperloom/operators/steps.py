"""Steps that are worked out once: lineage cut in the folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out into the checkpoint folder, so that what follows reads it, whatever executor is lost.

    The folder is spark.checkpoint.dir, or the context's, or with a local master one under the
    warehouse; a cluster without one is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.paperloom"
        context.setCheckpointDir(found)
    return df.checkpoint(eager=True)
