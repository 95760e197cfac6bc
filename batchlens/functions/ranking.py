"""Positions inside large groups without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.session import LoopState


def group_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row in its group, ordered by ``order``.

    Rows are range-partitioned by (keys, order), numbered inside each slice of
    a group, and shifted by the size of the group's earlier slices, so a group
    holding most of the rows is still spread over many tasks.
    """
    state = LoopState(df.sparkSession, "index")
    keys, order = list(keys), list(order)
    # the slice number is stored, so a re-run of a lost task cannot change it
    sliced, _ = state.save(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_pos") + F.col("_offset"))
        .drop("_slice", "_pos", "_offset")
    )
