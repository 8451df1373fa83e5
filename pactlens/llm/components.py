"""Connected components of a large edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """node, label: the smallest node that links reach; and the path of that table.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so paths shrink by half or better; sums per node are partial before they travel,
    so a node with very many links is no hot spot.  Every round is a written table.
    """
    spark = edges.sparkSession
    both, both_path = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct())
    labels, path = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("x")).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        of = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        jumped, new_path = written(lower.join(of, F.col("low") == F.col("n")).select("node", F.least("low", "l").alias("label"), "old"))
        changed = jumped.where("label <> old").limit(1).count()
        forget(spark, path)
        labels, path = jumped.select("node", "label"), new_path
        if not changed:
            forget(spark, both_path)
            return labels, path
