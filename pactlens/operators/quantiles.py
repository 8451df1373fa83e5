"""Exact quantiles of groups of any size.

The value of a rank is searched by ranges: the rows of a group are counted in so many ranges
of values, the range that holds the rank is the next to be divided, and once it holds few
rows (or one value only) they are looked at.  Counts are summed ahead of each exchange, so
neither a group nor its different values come together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.staging import stage

#: Ranges per step; rows of one range that are looked at; ranks sought up to which their table is broadcast.
RANGES, FEW, BROADCAST_RANKS = 1024, 10_000, 100_000


def _sought(sizes: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, rank, low, high, before): the ranks that the shares lie between, with the whole range of their group."""
    places = F.array(*[F.lit(p) * (F.col("n") - 1) for p in shares])
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x)), F.transform(places, lambda x: F.ceil(x))))
    return sizes.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("before"))


def _rows_sought(samples: DataFrame, sought: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows within the range of each rank."""
    if sought.count() <= BROADCAST_RANKS:
        sought = F.broadcast(sought)
    ranks = sought.select(F.struct(*keys).alias("of"), "rank", "low", "high", "before")
    met = F.col(value).between(F.col("low"), F.col("high"))
    for k in keys:
        met = met & F.col(f"of.{k}").eqNullSafe(F.col(k))
    return samples.select(*keys, value).join(ranks, met).drop("of")


def _narrowed(samples: DataFrame, sought: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One step: for each rank the range that holds it, now between values that occur, and the rows in it."""
    rows = _rows_sought(samples, sought, keys, value)
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).otherwise(0)
    counted = rows.groupBy(*keys, "rank", "before", F.least(place, F.lit(RANGES - 1)).alias("range")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    ahead = Window.partitionBy(*keys, "rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0))
    return counted.withColumn("before", before).where(F.col("rank").between(F.col("before"), F.col("before") + F.col("n") - 1)).drop("range")


def ranked_values(samples: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, rank, value): the values at the ranks (from 0) that the shares lie between; nulls do not count."""
    rows = samples.where(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    sought = stage(_sought(sizes, keys, shares))
    found = None
    while not sought.isEmpty():
        narrow = stage(_narrowed(rows, sought, keys, value))
        one = narrow.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
        few = narrow.where(f"low < high and n <= {FEW}")
        listed = _rows_sought(rows, few, keys, value).groupBy(*keys, "rank", "before").agg(F.array_sort(F.collect_list(value)).alias("values"))
        listed = listed.select(*keys, "rank", F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
        here = one.unionByName(listed)
        found = here if found is None else found.unionByName(here)
        sought = narrow.where(f"low < high and n > {FEW}").drop("n")
    return found if found is not None else sought.select(*keys, "rank", F.col("low").alias("value"))


def with_quantiles(groups: DataFrame, samples: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups(keys, n)`` with one column for each named share, interpolated between the ranks around it."""
    values = ranked_values(samples, keys, value, list(shares.values())).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    ).select(F.struct(*keys).alias("of"), "at")

    def between(share: float) -> Column:
        place = F.lit(share) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col("at")[low]).otherwise((high - place) * F.col("at")[low] + (place - low) * F.col("at")[high])

    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"of.{k}").eqNullSafe(F.col(k))
    return groups.join(values, met, "left").withColumns({name: between(p) for name, p in shares.items()}).drop("of", "at")
