"""Global order without a single task: running sums, row numbers, ranks and percentiles over range partitions.

Rows are sorted in ranges and saved, so ranges stay what they are; the driver holds one sum
for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list, add: Column, name: str, save) -> DataFrame:
    """df with ``name``: the sum of ``add`` over all rows before, in that order. Rows of equal order keys are taken as they come."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = save(df.withColumn("_add", add.cast("long")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    before, offsets = 0, []
    for r in dealt.groupBy("_range").agg(F.sum("_add").alias("s")).orderBy("_range").collect():  # a row for each range
        offsets += [F.lit(r["_range"]), F.lit(before)]
        before += r["s"] or 0
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_add", "_range")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.create_map(*offsets)[F.col("_range")]
    return dealt.withColumn(name, (F.coalesce(F.sum("_add").over(within), F.lit(0)) + start).cast("long")).drop("_add", "_range")


def average_ranks(df: DataFrame, column: str, name: str, save) -> DataFrame:
    """(column, name): each distinct value with the mean of the ranks, from 1, that its rows share."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    return running(counts, [F.col(column)], F.col("_n"), name, save).select(column, (F.col(name) + (F.col("_n") + 1) / 2).alias(name))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], save) -> DataFrame:
    """(by, share, value): exact percentiles with linear interpolation of each group, nulls left out; a large group is counted in many tasks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running(counts, [*[F.col(c) for c in by], F.col(value)], F.col("_n"), "_before", save)
    groups = placed.groupBy(*by).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_all"))
    asked = groups.select(*by, "_start", "_all", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("_at", F.col("share") * (F.col("_all") - 1)).withColumn("_low", F.col("_start") + F.floor("_at")).withColumn("_high", F.col("_start") + F.ceil("_at"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    inside = lambda p: (F.col(p) >= F.col("x._before")) & (F.col(p) < F.col("x._before") + F.col("x._n"))
    on = inside("y._low") | inside("y._high")
    for s in same:
        on = on & s
    hit = placed.alias("x").join(F.broadcast(asked).alias("y"), on)  # a row for each group and share
    return hit.groupBy(*[F.col(f"y.{c}").alias(c) for c in by], "share").agg(
        F.max(F.when(inside("y._low"), F.col(f"x.{value}"))).alias("_low_value"),
        F.max(F.when(inside("y._high"), F.col(f"x.{value}"))).alias("_high_value"), F.max(F.col("_at") - F.floor("_at")).alias("_part"),
    ).select(*by, "share", (F.col("_low_value") + (F.col("_high_value") - F.col("_low_value")) * F.col("_part")).alias(value))
