"""Cutting lineage in loops, in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Unset, it is an error on a cluster; on one machine (tests) a temporary one is set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, checkpointed into the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for a row. A filter on a plain column is moved below it with its definition in the column's place, so that parsed texts would be parsed again for each mention, and theirs for each of these; what a generator gives stays as it is."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
