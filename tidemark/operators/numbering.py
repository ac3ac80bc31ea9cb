"""Consecutive ids over a whole table without gathering it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import store


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with ids from `first` on in the given order.

    Rows are sorted by range, and each is written with its range and its place in it; its id is that place
    after the sizes of the ranges before, of which only one number for each range reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = store(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(parts))]
    offsets = F.array(*[F.lit(x).cast("long") for x in before])
    return placed.withColumn(name, F.get(offsets, F.col("_part")) + F.col("_place") + first).drop("_part", "_place")
