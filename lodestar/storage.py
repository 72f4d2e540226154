"""The folder that executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; one is set only where the session names none and the master is local, as in tests."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and survives lost executors.

    The folder is the session's; what is written there can go when the session ends. ``replaces``: a stored table that
    nothing needs once this one is written, as in the steps of a loop; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if replaces is not None and (old := getattr(replaces, "stored_at", None)):
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return out
