"""Mixing sources to target weights (operator 4), in DataFrame functions only.

Words are summed per source (a partial sum on every task, so a hot source costs nothing),
targets and repetition rates follow from that table of one row per source, and each document
is taken floor(rate) times plus one more time if its hash-seeded coin falls below the
fraction.  The coin depends on seed, id and text alone, so reruns agree and any partitioning
gives the same mix.

Targets fill up like water: sources in order of cap / weight, those that would rise above
their cap stop there, the others share the rest by weight.  That is the limit of resharing
an excess round after round.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
rows that repeat (same id and text) share their coin; an empty table, or one without words,
gives targets of 0 and takes nothing; other columns pass through ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import NOT_SPACE, fresh, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix"
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("bigint")


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed, id and text: its first 52 bits."""
    key = F.concat_ws("|", F.lit(seed), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, *, source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Per source: mix_source, source_size, target, rate.

    The windows run over this table only, one row per source.
    """
    sizes = docs.select(F.col(source_col).alias("mix_source"), n_words(F.col(text_col)).alias("n")).groupBy("mix_source").agg(F.sum("n").alias("source_size"))
    in_order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("top", cap * F.col("source_size"))
    whole = Window.partitionBy()
    rising = Window.orderBy(F.col("top") / F.col("w"), F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*", (share * F.sum("source_size").over(whole)).alias("all"), F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("top").over(rising), F.lit(0.0)).alias("top_before"), F.coalesce(F.sum("w").over(rising), F.lit(0.0)).alias("w_before"),
    )
    # A source stops at its cap if the level that all from it on would share lies above.
    stops = level.withColumn("stops", F.col("top") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all") - F.col("top_before")))
    rest = stops.select(
        "*", (F.col("all") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("top"))).over(whole), F.lit(0.0))).alias("left_all"),
        F.sum(F.when(~F.col("stops"), F.col("w"))).over(whole).alias("left_w"),
    )
    target = F.when(F.col("stops"), F.col("top")).otherwise(F.col("left_all") * F.col("w") / F.col("left_w"))
    return rest.select("mix_source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, rate, copies."""
    mix = fresh(docs, "mix")
    rates, _ = written(source_rates(docs, source_col=source_col, text_col=text_col, **how).select(F.struct("*").alias(mix)))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # checked; with more sources the join shuffles and splits hot ones
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col(f"{mix}.mix_source")), "left")
    rate = F.col(f"{mix}.rate")
    taken = F.floor(rate) + (coin(F.col(id_col), F.col(text_col), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.withColumn(mix, F.struct(
        n_words(F.col(text_col)).alias("size"), F.col(f"{mix}.source_size").alias("source_size"), F.col(f"{mix}.target").alias("target"),
        rate.alias("rate"), taken.alias("copies"),
    ))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, same columns."""
    counted = copies(docs, **how)
    mix = next(c for c in counted.columns if c not in docs.columns)
    times = fresh(counted, "times")
    wanted = counted.where(F.col(f"{mix}.copies") > 0)
    return wanted.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies").cast("int")))).select(*docs.columns)
