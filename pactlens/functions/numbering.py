"""Row numbers within groups of any size, without a task that holds a whole group.

Rows are dealt by range of (group, order) and sorted, so a group of a third of all rows
spreads over many parts.  A row's number is its place in its part plus the rows that its
group has in earlier parts; the latter come from one narrow row per part and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.staging import scratch_folder

#: Offsets (one row per part and group) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_OFFSETS = 50_000


def numbered(rows: DataFrame, group: list[str], order: list[str], pos: str = "pos", total: str = "total") -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... in ``order`` within ``group``) and ``total`` (rows of the group), both long.

    Nulls come first and form a group of their own.  Rows that tie in ``order`` are numbered in
    some order; equal rows are dealt to different parts, too.  The sorted rows are written
    to the shared folder of the checkpoints, which ends their lineage.
    """
    spark = rows.sparkSession
    path = scratch_folder(spark)
    keys = [*group, *order, "_spread"]
    (
        rows.withColumn("_spread", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread")
        .withColumn("_at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    )
    written = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    runs = written.groupBy("_part", *group).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select(
        F.struct("_part", *group).alias("_key"), (before - F.col("first")).alias("_shift"), F.sum("n").over(of_group).alias(total)
    )
    if runs.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same = F.col("_key._part") == F.col("_part")
    for c in group:
        same = same & F.col(f"_key.{c}").eqNullSafe(F.col(c))
    return written.join(offsets, same).withColumn(pos, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_key", "_shift")
