"""The folder for intermediate files and tables that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session, as in tests, gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="sparkloom-")


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{_base(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut: lost executors cost nothing that is done. Shuffles and tables
    of earlier steps that nothing refers to any more leave the disk first, not when the driver happens to collect garbage."""
    spark = df.sparkSession
    spark.sparkContext._jsc.emptyRDD().count()  # listeners hold the last query until they hear of another job
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_base(spark))
    return df.checkpoint()
