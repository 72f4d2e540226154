"""What the operators share: reading tables, the checkpoint folder, blocks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder, stored  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(spark: SparkSession) -> int:
    """The number of slices of a hash space: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions(spark: SparkSession) -> int:
    """The number of blocks: twice the session's shuffle partitions, as a block's texts are held in memory."""
    return 2 * slices(spark)
