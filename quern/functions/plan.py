"""Hints to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opaque(value: Column) -> Column:
    """``value``, which filters are not pushed through.

    The optimizer copies a column's whole expression into a filter on it, even into lambdas that then compute it anew for each character.  The condition is never
    true, but the optimizer cannot know that.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` (a plain scan of files), dealt round to all cores where it has few splits, as a small file of one row group has; large inputs have more splits than that and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan
