"""Cutting the plans of iterative jobs through the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file:///tmp/checkpoints")
    return df.checkpoint()
